"""Deterministic stand-ins for the user's model callables (used by the registered
queries and tests). Their outputs are simple functions of the row, so the SQL
oracle can reproduce them."""

from __future__ import annotations

import pandas as pd

STUB_DIMS = 8
STUB_FAIL_MOD = 23


def stub_embed(batch: pd.DataFrame) -> list[list[float]]:
    """Vector ``[(doc_id * j) % 13 for j in 1..8]``; the whole batch raises when it
    holds a key divisible by 23, so batch -> item retry must isolate those keys."""
    keys = batch["doc_id"].astype("int64").tolist()
    bad = [k for k in keys if k % STUB_FAIL_MOD == 0]
    if bad:
        raise RuntimeError(f"stub embedder failed on key {bad[0]}")
    return [[float((k * j) % 13) for j in range(1, STUB_DIMS + 1)] for k in keys]


def stub_generate(prompts, contents) -> list[str]:
    """``Final Answer: Yes`` when ``len(prompt) + key`` is even, else ``No``."""
    out = []
    for p, key in zip(prompts, contents):
        out.append("Final Answer: Yes" if (len(p) + int(key)) % 2 == 0 else "Final Answer: No")
    return out


def stub_extract(texts) -> list[list[dict]]:
    """Whitespace tokens as entities, labelled by token-length parity, no relations."""
    return [[{"token": w, "label": "EVEN" if len(w) % 2 == 0 else "ODD", "relation": None}
             for w in (t or "").split()] for t in texts]


# Fixed answers of the three-way classification stub, chosen by (len(prompt) + key) % 3.
STUB_ANSWERS = ["Final Answer: Yes", "Final Answer: No", "Unclear."]


def stub_classify(prompts, contents) -> list[str]:
    return [STUB_ANSWERS[(len(p) + int(k)) % 3] for p, k in zip(prompts, contents)]


def stub_decode(content: bytes) -> bytes:
    """The bytes themselves; an empty file cannot be opened."""
    if not content:
        raise ValueError("empty image")
    return content


def stub_size(image: bytes) -> str:
    return f"{len(image)}x1"


def stub_describe(prompts, images) -> list[str]:
    """``Final Answer: Yes`` when ``len(prompt) + len(image)`` is even, else ``No``; a batch with an image of a
    length divisible by 17 fails as a whole, so the failing items must be found."""
    if any(len(im) % 17 == 0 for im in images):
        raise RuntimeError("stub generator failed")
    return ["Final Answer: Yes" if (len(p) + len(im)) % 2 == 0 else "Final Answer: No" for p, im in zip(prompts, images)]


def stub_classify_image(prompts, images) -> list[str]:
    return [STUB_ANSWERS[(len(p) + int(im)) % 3] for p, im in zip(prompts, images)]


def stub_classify_path(prompts, paths) -> list[str]:
    """As ``stub_classify``, by the patient number in the path."""
    return [STUB_ANSWERS[(len(p) + int(path.split("patient")[1].split("/")[0])) % 3] for p, path in zip(prompts, paths)]
