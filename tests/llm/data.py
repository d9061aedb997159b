"""Small tables with everything that an operator must bear."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, class long, score double, h long, host string, bad string, block string"

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(20_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly forge bright amulets beneath an old stone bridge"


def rows():
    """Null ids and texts, empty, blank and very long texts, ties, repeated rows, near copies, shared passages, odd characters."""
    base = [f"w{i} x{i * 7 % 31} y{i * 3 % 17} z{i}" for i in range(60)]
    near = base.copy()
    near[30] = "changed"
    texts = [
        (None, None), (None, "no id " + " ".join(base)), (1, None), (2, ""), (3, "   \n\t "), (4, " ".join(base)), (5, " ".join(near)), (6, " ".join(base)), (6, " ".join(base)),
        (7, LONG), (8, LONG + " tail"), (9, "a"), (10, "a"), (11, "one two three four"), (12, "ONE two three four"), (13, f"start {PASSAGE} end one"), (14, f"other words {PASSAGE} and more"),
        (15, "ünï¢ödé " * 30), (16, "🙂" * 40), (17, "🙂" * 41), (18, "x" * 5000), (19, "x" * 4999), (20, "line one\nline two\n\nline one"), (21, "line one\r\nline two"), (21, "another text of the same id"),
    ]
    langs = ["en", "de", None, "fr"]
    return [(i, t, langs[k % 4], ["s0", "s0", "s1", None][k % 4], len(t or ""), "k", 1, 0.5, 2, "hh", "bb", "b") for k, (i, t) in enumerate(texts)]


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def texts(spark, pairs):
    return spark.createDataFrame([(i, t, None, None, 0, None, None, None, None, None, None, None) for i, t in pairs], SCHEMA)
