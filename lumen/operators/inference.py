"""M1/M2: user model calls over Arrow batches with per-item failure capture.

The model is a user callable; Spark partitions the rows, ``mapInPandas``
streams Arrow batches into the Python worker, and the callable sees
``batch_size`` rows at a time. A failing batch is retried item by item so
only the bad items become ``failed`` rows (``reason``/``error`` kept); the
rest of the batch still succeeds. Only ``Exception`` is caught -- a lost
worker or executor still fails the task and Spark's own retry takes over.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_MODELS: dict[str, object] = {}  # per Python worker: loaded once, reused by every task


def _model_key(name: str | None) -> str:
    """A worker keeps a model under its own name, or under an id of this call: two loaders never share one."""
    return name or uuid.uuid4().hex


def _load(loader: Callable[[], object] | None, key: str):
    if loader is None:
        return None
    if key not in _MODELS:
        _MODELS[key] = loader()
    return _MODELS[key]


def _answers(call, prompts: list, contents: list) -> list[str]:
    """Stripped answers of one model call; a wrong number or a missing answer is an error."""
    got = list(call(prompts, contents))
    if len(got) != len(prompts):
        raise ValueError(f"generator returned {len(got)} answers for {len(prompts)} prompts")
    if any(a is None for a in got):
        raise ValueError("generator returned no answer")
    return [str(a).strip() for a in got]


def _isolate_answers(call, prompts: list, contents: list) -> tuple[list, list]:
    """Answers and errors of a batch; a failing batch is split until the failing items are alone."""
    if not prompts:
        return [], []
    try:
        return _answers(call, prompts, contents), [None] * len(prompts)
    except Exception as exc:
        if len(prompts) == 1:
            return [None], [repr(exc)]
    mid = len(prompts) // 2
    a, e = _isolate_answers(call, prompts[:mid], contents[:mid])
    b, f = _isolate_answers(call, prompts[mid:], contents[mid:])
    return a + b, e + f


def _chunks(pdf: pd.DataFrame, size: int):
    for i in range(0, len(pdf), max(1, size)):
        yield pdf.iloc[i:i + size]


def _with_cols(schema: T.StructType, extra: list[T.StructField]) -> T.StructType:
    have = {f.name for f in schema.fields}
    return T.StructType([f for f in schema.fields] + [f for f in extra if f.name not in have])


def _isolate(call, chunk: pd.DataFrame, batch_exc: Exception):
    """Find the failing items of a failed batch by bisection; every item ends up
    either embedded or failed on its own call (same outcome as item-by-item
    retries, with O(bad * log batch) calls instead of O(batch))."""
    n = len(chunk)
    if n == 1:
        try:
            return [list(map(float, list(call(chunk))[0]))], [None]
        except Exception as item_exc:
            return [None], [f"embedder, batch: {batch_exc!r}, alone: {item_exc!r}"]
    mid = n // 2
    vecs, errs = [], []
    for part in (chunk.iloc[:mid], chunk.iloc[mid:]):
        try:
            got = list(call(part))
            if len(got) != len(part):
                raise ValueError(f"embedder returned {len(got)} vectors for {len(part)} items")
            vecs += [list(map(float, v)) for v in got]
            errs += [None] * len(part)
        except Exception:
            v, e = _isolate(call, part, batch_exc)
            vecs += v
            errs += e
    return vecs, errs


def _isolate_vectors(embed, images: list) -> tuple[list, list]:
    """Vectors and errors of a batch of images; a failing batch is split until the failing images are alone."""
    try:
        got = [list(map(float, v)) for v in embed(images)]
        if len(got) != len(images):
            raise ValueError(f"{len(got)} vectors for {len(images)} images")
        return got, [None] * len(images)
    except Exception as exc:
        if len(images) == 1:
            return [None], [f"embedder: {exc!r}"]
    mid = len(images) // 2
    a, e = _isolate_vectors(embed, images[:mid])
    b, f = _isolate_vectors(embed, images[mid:])
    return a + b, e + f


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """Round-robin the (narrow) item rows over ``partitions`` tasks before a model
    stage: per-item model cost dwarfs the shuffle of ids and paths, and file
    splits rarely match the number of model workers."""
    return df.repartition(partitions) if partitions else df


def embed_batches(df: DataFrame, embed: Callable, batch_size: int = 64,
                  loader: Callable[[], object] | None = None, loader_name: str | None = None,
                  reason: str = "embedding_error", partitions: int | None = None) -> DataFrame:
    """M1: ``embed(batch_pdf[, model]) -> list[vector]`` per batch of rows.

    Output = input columns + ``embedding array<float>``, ``status`` ('ok' /
    'failed'), ``reason`` and ``error`` (batch message and item message). A
    failing batch is split until the failing items are isolated.
    """
    out_schema = _with_cols(df.schema, [
        T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("status", T.StringType()),
        T.StructField("reason", T.StringType()), T.StructField("error", T.StringType())])
    cols = [f.name for f in out_schema.fields]
    key = _model_key(loader_name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _load(loader, key)

        def call(chunk):
            return embed(chunk, model) if model is not None else embed(chunk)

        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            emb, err = [], []
            for chunk in _chunks(pdf, batch_size):
                try:
                    vecs = list(call(chunk))
                    if len(vecs) != len(chunk):
                        raise ValueError(f"embedder returned {len(vecs)} vectors for {len(chunk)} items")
                    emb += [list(map(float, v)) for v in vecs]
                    err += [None] * len(chunk)
                except Exception as batch_exc:
                    v, e = _isolate(call, chunk, batch_exc)
                    emb += v
                    err += e
            out = pdf
            out["embedding"] = emb
            out["error"] = err
            ok = out["error"].isna()
            out["status"] = ok.map({True: "ok", False: "failed"})
            out["reason"] = ok.map({True: None, False: reason})
            yield out[cols]

    return spread(df, partitions).mapInPandas(run, out_schema)


def generate_batches(df: DataFrame, generate: Callable, prompt_col: str = "prompt",
                     content_col: str | None = None, batch_size: int = 8,
                     loader: Callable[[], object] | None = None, loader_name: str | None = None,
                     out_col: str = "generated", partitions: int | None = None) -> DataFrame:
    """M2: ``generate(prompts, contents[, model]) -> list[str]``; output stripped,
    per-batch seconds split evenly over its items in ``time_s``; failed items
    get a null text and the error message.

    When ``prompt_col`` is an array (one prompt per condition of an item, as
    in classification), every prompt of the batch goes to the model in one
    call and the answers come back as an array in the same order -- the item
    stays one row, so item-level rules need no shuffle afterwards.
    """
    df = spread(df, partitions)
    if isinstance(df.schema[prompt_col].dataType, T.ArrayType):
        return _generate_per_item(df, generate, prompt_col, content_col, batch_size, loader, loader_name, out_col)
    out_schema = _with_cols(df.schema, [
        T.StructField(out_col, T.StringType()), T.StructField("time_s", T.DoubleType()),
        T.StructField("error", T.StringType())])
    cols = [f.name for f in out_schema.fields]

    key = _model_key(loader_name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _load(loader, key)

        def call(prompts, contents):
            return generate(prompts, contents, model) if model is not None else generate(prompts, contents)
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            all_p = pdf[prompt_col].tolist()
            all_c = pdf[content_col].tolist() if content_col else [None] * len(pdf)
            texts, errs, secs = [], [], []
            for i in range(0, len(pdf), max(1, batch_size)):
                prompts, contents = all_p[i:i + batch_size], all_c[i:i + batch_size]
                t0 = time.perf_counter()
                got, bad = _isolate_answers(call, prompts, contents)
                texts += got
                errs += bad
                secs += [(time.perf_counter() - t0) / max(1, len(prompts))] * len(prompts)
            pdf[out_col], pdf["time_s"], pdf["error"] = texts, secs, errs
            yield pdf[cols]

    return df.mapInPandas(run, out_schema)


def _generate_per_item(df, generate, prompt_col, content_col, batch_size, loader, loader_name, out_col):
    out_schema = _with_cols(df.schema, [
        T.StructField(out_col, T.ArrayType(T.StringType())), T.StructField("time_s", T.DoubleType()),
        T.StructField("error", T.StringType())])
    cols = [f.name for f in out_schema.fields]
    model_key = _model_key(loader_name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _load(loader, model_key)

        def call(prompts, contents):
            return generate(prompts, contents, model) if model is not None else generate(prompts, contents)
        for pdf in batches:
            for chunk in _chunks(pdf, batch_size):
                chunk = chunk.reset_index(drop=True)
                out = chunk.copy()
                lists = [list(p) for p in chunk[prompt_col].tolist()]
                keys = chunk[content_col].tolist() if content_col else [None] * len(chunk)
                flat_p = [p for ps in lists for p in ps]
                flat_k = [k for ps, k in zip(lists, keys) for _ in ps]
                t0 = time.perf_counter()
                answers, bad = _isolate_answers(call, flat_p, flat_k)
                dt = (time.perf_counter() - t0) / max(1, len(flat_p))
                res, err, pos = [], [], 0
                for ps in lists:
                    res.append(answers[pos:pos + len(ps)])
                    err.append(next((e for e in bad[pos:pos + len(ps)] if e is not None), None))
                    pos += len(ps)
                out[out_col], out["time_s"], out["error"] = res, dt, err
                yield out[cols]

    return df.mapInPandas(run, out_schema)


def embed_images(items: DataFrame, listing: DataFrame, decode: Callable, embed: Callable,
                 path_col: str = "resolved_path", batch_size: int = 64, normalize: bool = True,
                 listing_filter=None) -> DataFrame:
    """Image embedding (S7 -> M1 -> T16 -> J2): every item accounted for.

    The model runs on the *listing* side, straight out of the ``binaryFile``
    scan (``sources.tables.list_images(..., with_content=True)``), so image
    bytes never cross a shuffle; only the compact vectors are joined back to
    the items by path. ``listing_filter`` (a row-local Column predicate on
    the listing, e.g. the same patient-range rule as the items) keeps files
    that no item needs out of the model stage.

    Items without a file become ``file_not_found``; ``decode(bytes) -> image``
    failures ``image_open_error``; ``embed(list[image]) -> list[vector]``
    failures are isolated by bisection and become ``embedding_error``.
    Vectors are L2-normalised in the JVM. Output: the item columns plus
    ``embedding``, ``status``, ``reason``, ``error``.
    """
    from pyspark.sql import functions as F

    from lumen.functions.vectors import l2_normalize

    files = listing.select("path", "content")
    if listing_filter is not None:
        files = files.where(listing_filter)
    vec_schema = T.StructType([
        T.StructField("_lp", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("status", T.StringType()), T.StructField("reason", T.StringType()),
        T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths, contents = pdf["path"].tolist(), pdf["content"].tolist()
            n = len(paths)
            emb, st, rs, er = [None] * n, ["failed"] * n, [None] * n, [None] * n
            for lo in range(0, n, max(1, batch_size)):
                images, idx = [], []
                for i in range(lo, min(n, lo + batch_size)):
                    try:
                        images.append(decode(bytes(contents[i])))
                        idx.append(i)
                    except Exception as exc:
                        rs[i], er[i] = "image_open_error", repr(exc)
                if not images:
                    continue
                vecs, errors = _isolate_vectors(embed, images)
                for i, v, e in zip(idx, vecs, errors):
                    emb[i] = v
                    if e is None:
                        st[i] = "ok"
                    else:
                        rs[i], er[i] = "embedding_error", e
            yield pd.DataFrame({"_lp": paths, "embedding": emb, "status": st, "reason": rs, "error": er})

    vectors = files.mapInPandas(run, vec_schema)
    if normalize:
        vectors = vectors.withColumn("embedding", F.when(F.col("embedding").isNotNull(),
                                                         F.transform(l2_normalize("embedding"), lambda x: x.cast("float"))))
    j = items.join(vectors, items[path_col] == vectors["_lp"], "left")
    missing = F.col("_lp").isNull()
    return (j.withColumn("status", F.when(missing, F.lit("failed")).otherwise(F.col("status")))
             .withColumn("reason", F.when(missing, F.lit("file_not_found")).otherwise(F.col("reason")))
             .drop("_lp"))


#: Bytes of paths and prompts that one pass over the files broadcasts.
ASK_BYTES = 32 << 20

FAIL_GENERATE = "generation_error"


def generate_images(items: DataFrame, listing: DataFrame, decode: Callable, generate: Callable,
                    prompt_col: str = "prompt", path_col: str = "local_image_path", batch_size: int = 8,
                    loader: Callable[[], object] | None = None, loader_name: str | None = None,
                    out_col: str = "generated", size_of: Callable | None = None) -> DataFrame:
    """M2 with S7 and F5: prompts meet image bytes; every item is accounted for.

    ``listing`` is ``(path, content)`` (``sources.tables.list_images(...,
    with_content=True)``). The prompts go to the files: the distinct (path,
    prompt) pairs of the items, counted in bytes, are broadcast to the scan in
    passes of ASK_BYTES, so bytes are never shuffled. An image is decoded once
    for the prompts that follow each other in its task (for an array of
    prompts, one per condition, once for all), and ``generate(prompts,
    images[, model])`` answers a batch. Only answers leave the model stage.

    Output: the item columns, ``out_col`` (text, or an array when prompts are
    arrays), ``image_size`` (what ``size_of(image)`` returns), ``time_s``,
    ``status``, ``reason`` and ``error``. ``file_not_found``: no such file (or one
    without a byte, which the file source does not list) or a null path; ``image_open_error``: ``decode`` failed; ``generation_error``:
    the model failed on the item alone. A null prompt is empty.
    """
    from functools import reduce

    from pyspark.sql import functions as F

    from lumen.session import cut_lineage

    kind = items.schema[prompt_col].dataType
    many = isinstance(kind, T.ArrayType)
    empty = F.array().cast(kind) if many else F.lit("")
    ask = F.coalesce(F.col(prompt_col), empty)
    asks = cut_lineage(items.where(F.col(path_col).isNotNull()).select(F.col(path_col).alias("path"), ask.alias("_ask")).distinct())
    width = F.length("path") + (F.aggregate("_ask", F.lit(0), lambda n, p: n + F.coalesce(F.length(p), F.lit(0)) + 16) if many
                                else F.length("_ask")) + 64
    size = asks.agg(F.sum(width.cast("long"))).first()[0] or 0
    passes = max(1, -(-4 * size // ASK_BYTES))  # up to four bytes a character
    key = _model_key(loader_name)
    answer = T.ArrayType(T.StringType()) if many else T.StringType()
    schema = T.StructType([
        T.StructField("_path", T.StringType()), T.StructField("_ask", kind), T.StructField(out_col, answer),
        T.StructField("image_size", T.StringType()), T.StructField("time_s", T.DoubleType()),
        T.StructField("reason", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _load(loader, key)

        def call(prompts, images):
            return generate(prompts, images, model) if model is not None else generate(prompts, images)

        last = None  # path, image, size, error
        for pdf in batches:
            for chunk in _chunks(pdf, batch_size):
                n = len(chunk)
                lists = [list(a) if many else [a] for a in chunk["_ask"].tolist()]
                images, sizes, reasons, errors = [None] * n, [None] * n, [None] * n, [None] * n
                for i, (path, content) in enumerate(zip(chunk["path"].tolist(), chunk["content"].tolist())):
                    if last is None or last[0] != path:
                        try:
                            image = decode(bytes(content))
                            last = (path, image, size_of(image) if size_of else None, None)
                        except Exception as exc:
                            last = (path, None, None, repr(exc))
                    images[i], sizes[i], errors[i] = last[1:]
                    reasons[i] = "image_open_error" if errors[i] is not None else None
                asked = [(p, images[i]) for i in range(n) if reasons[i] is None for p in lists[i]]
                t0 = time.perf_counter()
                got, bad = _isolate_answers(call, [p for p, _ in asked], [im for _, im in asked])
                each = (time.perf_counter() - t0) / max(1, len(asked))
                texts, secs, at = [None] * n, [None] * n, 0
                for i in range(n):
                    if reasons[i] is not None:
                        continue
                    k = len(lists[i])
                    texts[i] = got[at:at + k] if many else got[at]
                    secs[i] = each * k if many else each
                    failed = next((e for e in bad[at:at + k] if e is not None), None)
                    if failed is not None:
                        reasons[i], errors[i] = FAIL_GENERATE, failed
                    at += k
                yield pd.DataFrame({"_path": chunk["path"].tolist(), "_ask": chunk["_ask"].tolist(), out_col: texts,
                                    "image_size": sizes, "time_s": secs, "reason": reasons, "error": errors})

    parts = []
    for k in range(passes):
        mine = F.pmod(F.xxhash64("path"), F.lit(passes)) == k
        parts.append(listing.select("path", "content").where(mine)
                     .join(F.broadcast(asks.where(mine)), "path").mapInPandas(run, schema))
    answers = reduce(DataFrame.unionByName, parts)
    names = [c for c in items.columns if c not in (out_col, "image_size", "time_s", "status", "reason", "error")]
    j = items.select(*names).join(answers, (items[path_col] == answers["_path"]) & (ask == answers["_ask"]), "left")
    reason = F.when(F.col("_path").isNull(), F.lit("file_not_found")).otherwise(F.col("reason"))
    return j.select(*[items[c] for c in names], out_col, "image_size", "time_s",
                    F.when(reason.isNull(), F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
                    reason.alias("reason"), "error")
