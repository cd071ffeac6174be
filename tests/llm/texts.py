"""Texts that the tests of the training-data operators share."""

DOCS = "doc_id long, text string"

EDGE_TEXTS = [None, "", " \t\n ", "one", "one two three", "a " * 30000, "x" * 50000, "ÄÖ é b \x1f c",
              "same words here again and again", "same words here again and again", "tail space ", "  lead",
              "a  b   c \n\n d \t e", "🙂 ok 🙂", "Null\x00byte"]
