"""Quality rules of documents, with verdicts on their hosts.

Every document is measured against rules. The failures are summed by host and
rule, and a host's rate for a rule is shrunk towards the rate of all hosts by a
beta prior, one for each rule, that is fitted to how the hosts' own rates
scatter. The shrunk rates give a verdict on the host, which is joined back: a
host that nearly always fails is dropped whole, and where a rule is hardly ever
failed, a failure of this rule alone is taken for chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches

SYMBOLS = b"#*$%&|<>"
#: Base rule: least words, and most words in repeated windows of three, in per cent.
LEAST_WORDS, MOST_REPEATS = 50, 50
#: Rules for documents: name and SQL condition of a failure.
RULES = {
    "symbols": "n_symbols > 0.1 * n_words",
    "dup_lines": "n_dup_lines > 0.3 * n_lines",
    "repeats": "n_repeat_words > 0.2 * n_words",
    "capitals": "n_capital_words > 0.5 * n_words",
    "word_length": "word_chars < 2.5 * n_words OR word_chars > 20 * n_words",
}
#: A host is condemned if its shrunk share of documents that fail any rule is at least this.
CONDEMNED = 0.8
#: A rule is lenient at a host whose shrunk rate is under this part of the rate of all, and under this rate.
LENIENT, HARDLY_EVER = 0.5, 0.05
#: Strength of the prior if the hosts' rates don't scatter.
STRONGEST = 1e4

COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_capital_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that are found twice or more, the first included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    bits = len(number).bit_length()
    if 3 * bits <= 63:
        keys = (ids[:-2] << 2 * bits) | (ids[1:-1] << bits) | ids[2:]
    else:  # over two million different words: number the pairs first
        pairs = np.unique((ids[:-2] << 31) | ids[1:-1], return_inverse=True)[1]
        keys = (pairs << 31) | ids[2:]
    _, of, n = np.unique(keys, return_inverse=True, return_counts=True)
    again = n[of] > 1
    inside = np.zeros(len(words), dtype=bool)
    for i in range(3):
        inside[i : i + len(again)] |= again
    return int(inside.sum())


def measure_text(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [line for line in text.split(b"\n") if not line.isspace() and line]
    joined = b"".join(words)
    return (
        len(words), len(joined.decode()), len(text) - len(text.translate(None, SYMBOLS)), len(lines),
        len(lines) - len(set(lines)), repeated_words(words), sum(map(bytes.isupper, words)),
    )


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of each whole text; null and empty texts have none of anything."""

    def run(texts: list[bytes]) -> list[pa.Array]:
        columns = list(zip(*map(measure_text, texts))) or [()] * 7
        return [pa.array(c, pa.int64()) for c in columns]

    return batches.extend(docs, text_col, COUNTS, run)


def base_failed() -> Column:
    return F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATS} * n_words")


def prior(failures: int, n: int, hosts: int, squares: float, spread: float) -> tuple[float, float]:
    """Mean and strength of a rule's beta prior, by the method of moments.

    ``squares`` is the sum of n * n over the hosts, ``spread`` that of k * k / n
    for their failures k. The strength follows from the variance of the rates
    beyond what chance gives.
    """
    mean = (failures + 1) / (n + 2)
    scatter = spread - 2 * mean * failures + mean * mean * n
    # its expectation is (hosts - 1) * mean * (1 - mean) by chance alone
    between = (scatter - (hosts - 1) * mean * (1 - mean)) / max(n - squares / n, 1e-9)
    return mean, STRONGEST if between <= 0 else min(STRONGEST, max(1.0, mean * (1 - mean) / between - 1))


def host_verdicts(measured: DataFrame) -> DataFrame:
    """(host, host_rate, condemned, lenient): the verdict on each host.

    ``measured`` has host, ``base_failed`` and ``failed``, the names of the
    rules that a document fails. ``host_rate`` is the shrunk share of documents
    that fail any rule or the base rule; ``lenient`` has the rules that count as
    chance there. Only sums over the hosts are on the driver.
    """
    tests = {"any": F.col("base_failed") | (F.size("failed") > 0)} | {r: F.array_contains("failed", r) for r in RULES}
    hosts = batches.stage(
        measured.groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(t).alias(f"k_{r}") for r, t in tests.items())), "quality-hosts")
    sums = hosts.agg(
        F.sum("n").alias("n"), F.count("*").alias("hosts"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
        *(F.sum(f"k_{r}").alias(f"k_{r}") for r in tests),
        *(F.sum(F.col(f"k_{r}").cast("double") * F.col(f"k_{r}") / F.col("n")).alias(f"s_{r}") for r in tests)).first()
    if not sums.n:
        return hosts.select("host", F.lit(0.0).alias("host_rate"), F.lit(False).alias("condemned"), F.array().cast("array<string>").alias("lenient"))
    priors = {r: prior(sums[f"k_{r}"], sums.n, sums.hosts, sums.squares, sums[f"s_{r}"]) for r in tests}
    rate = {r: (F.col(f"k_{r}") + mean * strength) / (F.col("n") + strength) for r, (mean, strength) in priors.items()}
    lenient = F.array_compact(F.array(*(F.when(rate[r] < min(LENIENT * priors[r][0], HARDLY_EVER), F.lit(r)) for r in RULES)))
    return hosts.select("host", rate["any"].alias("host_rate"), (rate["any"] >= CONDEMNED).alias("condemned"), lenient.alias("lenient"))


def judge(docs: DataFrame, host: Column, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with counts, ``failed``, ``base_failed``, ``host_rate`` and ``kept``.

    A document is kept if the base rule does not fail, its host is not
    condemned, and it fails no rule, or one alone that is lenient at its host.
    A null or empty text fails the base rule. Documents with a null host form
    one host. Rows are counted as they come, repeated ones too. Columns named
    like the new ones are replaced. An empty table gives an empty one.
    """
    names = [c for c in docs.columns if c != text_col]
    counts = [part.split()[0] for part in COUNTS.split(", ")]
    new = [*counts, "failed", "base_failed", "host_rate", "kept", "host"]
    rows = measure(docs.select(F.struct(*names).alias("row"), host.alias("host"), F.col(text_col).alias("text"))).drop("text")
    failed = F.array_compact(F.array(*(F.when(F.expr(rule), F.lit(r)) for r, rule in RULES.items())))
    rows = batches.stage(rows.withColumns({"failed": failed, "base_failed": base_failed()}), "quality")
    small = batches.broadcast_if_small(batches.stage(host_verdicts(rows), "quality-verdicts"))
    joined = rows.join(small, rows.host.eqNullSafe(small.host), "left").drop(small.host)
    by_chance = (F.size("failed") == 1) & F.arrays_overlap("failed", "lenient")
    return joined.select(
        *(F.col("row")[c].alias(c) for c in names if c not in new), *counts, "failed", "base_failed", "host_rate",
        (~F.col("base_failed") & ~F.col("condemned") & ((F.size("failed") == 0) | by_chance)).alias("kept"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, counts, base rule, host rate and verdict of every document; the host is its source."""
    docs = batches.table(spark, folder, "documents").select("doc_id", "source", "text")
    return judge(docs, F.col("source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.size("failed").alias("n_failed"), "host_rate")
