"""Language identification by compression.

Each language has a zstandard raw-content dictionary of sampled text. A text is
compressed with every dictionary and belongs to the language whose dictionary
gives the fewest bytes. Where the runner-up is almost as good the answer is
marked as not accepted. Both sides are lower-cased words joined by blanks, so that
capitals, digits and punctuation have no say.

Training reads all labelled rows and keeps a bounded sample: per language at
most ``pieces`` stretches of ``piece_chars`` characters, one for each bucket of
the texts' hashes, the text with the smallest hash in it. So no more than
languages x pieces x piece_chars characters reach the driver, and copies of one
text count once. Labels of more than ``max_languages`` kinds are an error, so that a
dirty column cannot fill the driver. Prediction sees nothing but the text.

Cases: null texts and texts without a letter are ``und`` with score 0, not
accepted; without any labelled text everything is; ties go to the language
with more labelled texts; very long texts are compressed in blocks and their sizes added;
repeated rows are judged each; other columns are not read.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.arrow import map_batches

UNKNOWN = "und"
BLOCK = 2048
_NO_LETTERS = re.compile(r"[\W\d_]+")


def train(
    labelled: DataFrame, pieces: int = 192, piece_chars: int = 512, max_languages: int = 256
) -> dict[str, bytes]:
    """Dictionaries by language from the columns ``text`` and ``lang``, the most frequent language first."""
    counts = labelled.where("lang IS NOT NULL").groupBy("lang").count().limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} different labels; clean the column lang or raise max_languages")
    often = {r["lang"]: r["count"] for r in counts}
    texts = labelled.where("lang IS NOT NULL").where(F.col("text").rlike(r"\p{L}")).select(
        "lang", "text", F.xxhash64("text").alias("h")
    )
    bucket = F.pmod(F.col("h"), F.lit(pieces))
    chosen = texts.groupBy("lang", bucket.alias("bucket")).agg(F.min("h").alias("h")).select("lang", "h")
    start = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - piece_chars, F.lit(1))).cast("int") + 1
    rows = (
        texts.join(F.broadcast(chosen), ["lang", "h"])  # at most max_languages x pieces rows, so texts stay where they are
        .select("lang", "h", F.substring(F.col("text"), start, F.lit(piece_chars)).alias("piece"))
        .groupBy("lang", "h")
        .agg(F.min("piece").alias("piece"))
        .orderBy("lang", "h")
        .collect()
    )
    found: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: (-often[r["lang"]], r["lang"])):
        found.setdefault(row["lang"], []).append(plain(row["piece"]))
    return {lang: b"".join(parts) for lang, parts in found.items()}


def plain(text: str) -> bytes:
    """Lower-case words between single blanks."""
    return _NO_LETTERS.sub(" ", f" {text.lower()} ").encode("utf-8", "surrogatepass")


@functools.lru_cache(maxsize=4)
def _compressors(models: tuple[tuple[str, bytes], ...], level: int):
    out = []
    for lang, content in models:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        parameters = zstandard.ZstdCompressionParameters.from_level(
            level, source_size=BLOCK, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        held.precompute_compress(compression_params=parameters)
        out.append((lang, zstandard.ZstdCompressor(dict_data=held, compression_params=parameters)))
    return out


def classify(text: str | None, models, level: int, margin: float) -> tuple[str, float, bool]:
    """(language, score, accepted). The score is the share by which the runner-up is larger, five times, at most 1."""
    if not text or not models or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, False
    raw = plain(text)
    blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
    sizes = sorted(
        ((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in _compressors(models, level)), key=lambda x: x[0]
    )
    ahead = 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], min(1.0, ahead * 5), ahead >= margin


def identify(docs: DataFrame, models: dict[str, bytes], level: int = 9, margin: float = 0.01) -> DataFrame:
    """doc_id, lang_pred, score and accepted for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(models.items()))

    def work(batches):
        for batch in batches:
            found = [classify(t, shared.value, level, margin) for t in batch.column("text").to_pylist()]
            yield [
                batch.column("doc_id").cast(pa.int64()),
                [x[0] for x in found],
                [x[1] for x in found],
                [x[2] for x in found],
            ]

    return map_batches(
        docs.select("doc_id", "text"), work, "doc_id long, lang_pred string, score double, accepted boolean"
    )
