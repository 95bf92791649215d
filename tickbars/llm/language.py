"""Language by compression: the dictionary that shortens a text most names its language.

Each language gets a zstandard raw-content dictionary of texts in that language. A text is brought to lower-case
letters, cut into blocks, and every block of it is compressed with each dictionary; sizes are summed over the whole
text. Blocks keep the dictionary in force to the end of long texts.

The classifier is fitted on a bounded sample: at most SAMPLE_ROWS rows a language, SAMPLE_CHARS of each and DICT_BYTES
in all. The rows are those of the smallest hash, so they do not depend on the order or the number of files.

Defined cases: a text that is null or has no letter is `und` with score 0 and rejected; so is every text if no row
is labelled. Equal sizes go to the language with more labelled rows, then to the smaller name. Repeated rows get
repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UNDETERMINED = "und"
SAMPLE_ROWS = 400
SAMPLE_CHARS = 2_000
DICT_BYTES = 512 << 10
BLOCK_BYTES = 4_096
LEVEL = 9
# The least part of the second-best size by which the best has to be smaller.
MARGIN = 0.004

_NOT_LETTERS = regex.compile(r"[^\p{L}]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def normal(text: str) -> bytes:
    """Lower-case letters with single spaces for all else."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode()


@dataclass(frozen=True)
class Languages:
    """Names, the most frequent first, and the dictionary of each."""

    names: list[str]
    contents: list[bytes]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in self.contents:
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=LEVEL)
            options = {"dict_data": shared, "write_content_size": False, "write_checksum": False}
            out.append(zstandard.ZstdCompressor(level=LEVEL, write_dict_id=False, **options))
        return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Languages:
    """Dictionaries from the labelled rows that are not held out."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    labelled = labelled.select(
        F.col(lang_col).alias("lang"),
        F.substring(F.col(text_col), 1, SAMPLE_CHARS).alias("text"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("at"),
    )
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Languages([], [])
    # Twice the wanted share by hash, then the smallest hashes of each language among those few rows.
    below = {lang: int(min(1.0, 2 * SAMPLE_ROWS / n + 1e-6) * 2**62) for lang, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for pair in below.items() for x in pair])[F.col("lang")]
    few = labelled.where(F.shiftrightunsigned("at", 2) < limit).orderBy("lang", "at", "text").collect()
    texts: dict[str, list[str]] = {}
    for row in few:
        if len(mine := texts.setdefault(row["lang"], [])) < SAMPLE_ROWS:
            mine.append(row["text"])
    names = sorted(texts, key=lambda lang: (-counts[lang], lang))
    contents = []
    for name in names:
        parts = [normal(t) for t in texts[name]]
        share = max(64, DICT_BYTES // max(1, len(parts)))
        contents.append(b" ".join(p[:share] for p in parts)[-DICT_BYTES:] or b" ")
    return Languages(names, contents)


def predict(df: DataFrame, languages: Languages, text_col: str = "text") -> DataFrame:
    """The frame with `lang_pred`, `score` (0 to 1, from the margin) and `rejected` (narrow margin or undetermined).

    Columns of these names that the frame has are replaced.
    """
    kept = [c for c in df.columns if c not in ("lang_pred", "score", "rejected")]
    at = kept.index(text_col)
    frame = df.select(*(F.col(f"`{c}`") for c in kept))
    added = "lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = languages.compressors()

        def judge(text: str | None) -> tuple[str, float, bool]:
            data = normal(text) if text else b""
            if not data or not compressors:
                return UNDETERMINED, 0.0, True
            blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
            sizes = [sum(len(c.compress(b)) for b in blocks) for c in compressors]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            others = [s for i, s in enumerate(sizes) if i != best]
            margin = 1 - sizes[best] / min(others) if others else 1.0
            return languages.names[best], margin / (margin + MARGIN) if margin else 0.0, margin < MARGIN

        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(at)]
            if found:
                new = [pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*kept, "lang_pred", "score", "rejected"])

    return frame.mapInArrow(run, StructType([*frame.schema.fields, *StructType.fromDDL(added).fields]))


def language_report(docs: DataFrame) -> DataFrame:
    """The prediction for every document, learnt from those that are not held out."""
    languages = fit(docs)
    asked = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(asked, languages).drop("text")
