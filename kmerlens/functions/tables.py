"""Table functions for SQL: ``kmers(seq, k)`` and ``neighbors(kmer, radius)``.

They are for questions by hand; plans over whole tables take ``operators.counting`` and
``operators.mismatch``, which work on batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def _canonical(kmer: str) -> str:
    return min(kmer, kmer[::-1].translate(_COMPLEMENT))


class Kmers:
    """Rows (start, kmer, strand) of the windows of ACGT only; kmer is canonical."""

    def eval(self, seq: str, k: int) -> Iterator[tuple[int, str, str]]:
        text = (seq or "").upper()
        for i in range(len(text) - k + 1):
            window = text[i : i + k]
            if not window.strip("ACGT"):
                kmer = _canonical(window)
                yield i, kmer, "+" if kmer == window else "-"


class Neighbors:
    """Rows (kmer, d) of the canonical k-mers within the radius in either orientation, each once."""

    def eval(self, kmer: str, radius: int) -> Iterator[tuple[str, int]]:
        seen: set[str] = set()
        for d in range(radius + 1):
            for places in combinations(range(len(kmer)), d):
                for bases in product("ACGT", repeat=d):
                    text = list(kmer)
                    for place, base in zip(places, bases, strict=True):
                        text[place] = base
                    found = _canonical("".join(text))
                    if found not in seen:
                        seen.add(found)
                        yield found, d


def register(spark: SparkSession) -> None:
    """Makes both functions known to the session's SQL."""
    spark.udtf.register("kmers", udtf(Kmers, returnType="start int, kmer string, strand string"))
    spark.udtf.register("neighbors", udtf(Neighbors, returnType="kmer string, d int"))
