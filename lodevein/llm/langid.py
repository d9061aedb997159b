"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of training texts.  A text is cut into blocks, each
block is compressed with every dictionary, and the language with the smallest sum over the whole text wins.
Where the runner-up comes within ``margin`` of the winner the answer is marked as rejected.

The dictionaries are filled from a bounded sample of the labelled rows (``sample_docs`` documents of each language
at most, ``dict_bytes`` bytes of dictionary): a fixed hash of the id decides, so reruns agree.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or where nothing can be learnt; rows
of null lang or null id teach nothing; ties go to the language that is first by code point; ids that repeat each give a
row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevein.llm.common import learns

DICT_BYTES = 96 * 1024
SAMPLE_DOCS = 400
SLICE = 1024
BLOCK = 2048
LEVEL = 3
MARGIN = 0.01
#: Bytes of all dictionaries together: of many languages each has a smaller one.
ALL_BYTES = 64 << 20


def sample_texts(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """At most about ``sample_docs`` distinct texts of each language, chosen by a hash of the id."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & learns(F.col("doc_id"))).select("lang", "text", F.xxhash64("doc_id").alias("h"))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return {}
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * sample_docs / r["count"])))])
    # By hash first, so that no task ever holds all rows of a language.
    near = known.filter(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - 4 * SLICE, F.lit(0)) + 1).cast("int") + 1
    rows = near.select("lang", "h", F.substring(F.col("text"), start, F.lit(4 * SLICE)).alias("text")).dropDuplicates(["lang", "text"]).collect()
    found: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["text"])):
        if len(own := found.setdefault(r["lang"], [])) < sample_docs:
            own.append(r["text"])
    return found


def dictionaries(texts: dict[str, list[str]], dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Slices of the sample texts, in turn, until each dictionary has its size."""
    made = {}
    dict_bytes = min(dict_bytes, max(SLICE, ALL_BYTES // max(1, len(texts))))
    for lang, own in sorted(texts.items()):
        parts, size, at = [], 0, 0
        while size < dict_bytes and at < 4:
            for t in own:
                piece = t.lower().encode()[at * SLICE : (at + 1) * SLICE]
                if piece and size < dict_bytes:
                    parts.append(piece)
                    size += len(piece)
            at += 1
        made[lang] = b"".join(parts)[:dict_bytes]
    return made


class Identifier:
    """Compressors of all languages; ``__call__`` gives language, score and whether the margin is too narrow."""

    def __init__(self, dicts: dict[str, bytes], margin: float = MARGIN):
        self.langs, self.margin, self.made = sorted(dicts), margin, []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(dicts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not self.made or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        raw = text.lower().encode("utf-8", "surrogatepass")
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = [sum(len(compress(b)) for b in blocks) for compress in self.made]
        ranked = sorted(zip(sizes, self.langs, strict=True))
        if len(ranked) == 1:
            return ranked[0][1], 1.0, False
        gap = (ranked[1][0] - ranked[0][0]) / ranked[1][0]
        return ranked[0][1], gap / (gap + 0.05), gap < self.margin


def predict(docs: DataFrame, dicts: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document."""

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Identifier(dicts, margin)
        for b in batches:
            found = [of(t) for t in b.column("text").to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *columns], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "text").mapInArrow(identify, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that may be learnt, predict for all."""
    return predict(docs, dictionaries(sample_texts(docs)))
