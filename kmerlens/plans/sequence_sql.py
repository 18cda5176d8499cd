"""DuckDB text of features of a 16-mer, written apart from the column functions that it checks."""

from __future__ import annotations


def run(k: str) -> str:
    return f"list_max(list_transform(regexp_extract_all({k}, '(A+|C+|G+|T+)'), lambda x: length(x)))"


def gc(k: str) -> str:
    return f"length(translate({k}, 'AT', ''))"


def entropy(k: str) -> str:
    n = f"(16 - length(replace({k}, x, ''))) / 16.0"
    return f"round(list_sum(list_transform(['A', 'C', 'G', 'T'], lambda x: CASE WHEN contains({k}, x) THEN -{n} * log2({n}) ELSE 0 END)), 9)"


def stem(k: str) -> str:
    """All pairs of places at least four apart; arms grow inwards while they pair and stay apart."""
    grown = f"list_position(list_transform(range(0, 9), lambda m: x // 16 + m < x % 16 - m AND translate(substr({k}, x // 16 + m + 1, 1), 'ACGT', 'TGCA') = substr({k}, x % 16 - m + 1, 1)), FALSE) - 1"
    return f"CAST(list_max(list_transform(list_filter(range(0, 256), lambda x: x % 16 >= x // 16 + 4), lambda x: {grown})) AS INTEGER)"


def gate(k: str) -> str:
    return f"{gc(k)} BETWEEN 4 AND 12 AND {run(k)} <= 5 AND {stem(k)} <= 5"


def quality(k: str) -> str:
    return f"round(0.35 * greatest(0, 1 - abs({gc(k)} / 16.0 - 0.5) / 0.25) + 0.20 * greatest(0, 1 - ({run(k)} - 3) / 4.0) + 0.25 * least(1, {entropy(k)} / 1.8) + 0.20 * greatest(0, 1 - ({stem(k)} - 2) / 4.0), 6)"


def shared(a: str, b: str, n: int = 12) -> str:
    """Whether a and b, or a and the reverse complement of b, share n bases in a row."""
    return "(" + " OR ".join(f"contains({b}, substr({a}, {i}, {n})) OR contains(reverse(translate({b}, 'ACGT', 'TGCA')), substr({a}, {i}, {n}))" for i in range(1, 18 - n)) + ")"
