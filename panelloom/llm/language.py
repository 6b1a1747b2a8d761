"""Language identification: the language whose dictionary compresses a text best wins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, free_names, remainder, small_batches

UNDETERMINED = "und"
#: Sampled documents of a language, characters taken from each, bytes of its dictionary.
PER_LANGUAGE, EXCERPT, DICTIONARY_BYTES = 320, 360, 110 << 10
#: Texts are encoded in independent blocks of so many bytes, so that all parts of a long text weigh alike.
BLOCK_BYTES, LEVEL = 4096, 6
#: A prediction is rejected if its lead in bytes is below MARGIN * best size + ALLOWANCE * its square root, at every size: leads of texts between
#: two languages wander with the root of the size. As a share of the size the allowance shrinks smoothly with length; a tie never passes.
MARGIN, ALLOWANCE = 0.002, 0.25
SEED = 29


@dataclass
class LanguageDictionaries:
    contents: dict[str, bytes]  # raw-content dictionary of each language, those with most documents first

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in self.contents.values():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out


def sizes(text: str, compressors: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Bytes that each compressor needs for the whole text, block by block."""
    raw = memoryview(text.lower().encode("utf-8", "surrogatepass"))
    total = np.zeros(len(compressors), dtype=np.int64)
    for i in range(0, len(raw), BLOCK_BYTES):
        block = raw[i : i + BLOCK_BYTES]
        total += [len(c.compress(block)) for c in compressors]
    return total


def fit_languages(docs: DataFrame, modulus: int = 4, held: int = 2, per_language: int = PER_LANGUAGE) -> LanguageDictionaries:
    """One dictionary a language, from excerpts of at most ``per_language`` documents with that ``lang`` outside the hold-out.

    Excerpts start at a place that depends on the id; of documents that share an id, the least excerpt counts. Only they (EXCERPT
    characters a document) reach the driver, where each gives its head, in whole characters, so that all of a language share DICTIONARY_BYTES alike.
    """
    rows = docs.where("lang is not null and length(text) > 0").where(remainder("doc_id", modulus) != held).select("doc_id", "lang").distinct()
    ids, sizes_ = bounded_sample(rows, "lang", "doc_id", per_language, SEED)
    start = F.expr(f"1 + pmod(xxhash64(doc_id), greatest(length(text) - {EXCERPT}, 1))").cast("int")
    excerpts = (
        docs.select("doc_id", "text").where("length(text) > 0").join(F.broadcast(ids.dropDuplicates(["doc_id"])), "doc_id")
        .groupBy("doc_id").agg(F.min(F.struct("lang", F.lower(F.expr("text").substr(start, F.lit(EXCERPT))).alias("part"))).alias("x")).select("doc_id", "x.*").collect()
    )
    parts: dict[str, list] = {}
    for r in sorted(excerpts, key=lambda r: (r["lang"], r["doc_id"], r["part"])):
        parts.setdefault(r["lang"], []).append(r["part"].encode("utf-8", "replace"))
    for k, own in parts.items():
        each = max(1, DICTIONARY_BYTES // len(own) - 1)
        parts[k] = [p[:each].decode("utf-8", "ignore").encode() for p in own]
    return LanguageDictionaries({k: b"\n".join(parts[k]) for k in sorted(parts, key=lambda k: (-sizes_[k], k))})


def predict_language(docs: DataFrame, model: LanguageDictionaries, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score (share of the best under weights 2 ** -bytes) and rejected (see MARGIN).

    A null text, one without a letter, and a model without languages give ``und``, score 0, rejected. Equal sizes go to the
    language with more documents. Extra columns pass through; those three names are replaced.
    """
    names = list(model.contents)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = model.compressors()
        for texts in batches:
            out = []
            for t in texts:
                s = sizes(t, compressors)
                best = int(s.argmin())
                others = np.delete(s, best)
                lead = others.min() - s[best] if len(others) else np.inf
                out.append((names[best], float(1 / np.exp2(-(s - s[best]).astype(float)).sum()), bool(lead < margin * s[best] + ALLOWANCE * np.sqrt(s[best]))))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    lettered = F.col(text).rlike(r"\p{L}") if names else F.lit(False)
    read, found = free_names(docs, "__text", "__found")
    out = small_batches(docs).withColumn(read, F.when(lettered, F.col(text)))
    return (
        out.withColumn(found, F.when(F.col(read).isNotNull(), predict(F.coalesce(read, F.lit("a")))))
        .withColumn("lang_pred", F.coalesce(f"{found}.lang_pred", F.lit(UNDETERMINED)))
        .withColumn("score", F.coalesce(f"{found}.score", F.lit(0.0)))
        .withColumn("rejected", F.coalesce(f"{found}.rejected", F.lit(True)))
        .drop(read, found)
    )
