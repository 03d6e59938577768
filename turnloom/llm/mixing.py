"""Mixing sources to target weights: raking of token weights, then calibrated sampling."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import spread_rank


def within_caps(weights: np.ndarray, caps: np.ndarray, total: float) -> np.ndarray:
    """``weights`` scaled to ``total``, none above its cap: what the capped ones can't take goes to the others."""
    out, free = np.zeros_like(weights), weights > 0
    for _ in range(len(weights) + 1):
        left = total - out[~free].sum()
        scaled = weights * (left / max(weights[free].sum(), 1e-300))
        over = free & (scaled > caps)
        out = np.where(free, scaled, out)
        if not over.any():
            break
        out[over], free = caps[over], free & ~over
    return np.minimum(out, caps)


def rake(cells: list[dict], shares: dict[str, float], repeats: dict[str, int], others: list[str], rounds: int = 1_000, marginals: dict[str, dict[str, float]] | None = None) -> tuple[np.ndarray, dict[str, float]]:
    """Copies of each cell's documents, and the source shares aimed at.

    ``cells`` have ``source``, ``tokens`` and the ``others``. Sources with tokens keep their proportions of
    ``shares``; the total is the largest that no source needs more than its repeats for. Weights are fitted
    to the marginals of ``others`` (shares by value in ``marginals``, else the corpus's own) and to the sources in turn, each within its caps; the
    sources come last, so their shares hold exactly. Marginals that can't all be met within the caps never
    settle: after ``rounds`` rounds a warning says how much weight still moves.
    """
    tokens = np.array([float(c["tokens"]) for c in cells])
    source = np.array([c["source"] for c in cells], object)
    sizes = {s: tokens[source == s].sum() for s in shares}
    present = {s: w for s, w in shares.items() if w > 0 and sizes[s] > 0}
    aim = {s: w / sum(present.values()) for s, w in present.items()}
    if not aim:
        return np.zeros(len(cells)), {}
    total = min(repeats[s] * sizes[s] / w for s, w in aim.items())
    caps = np.array([repeats.get(s, 0) * t if s in aim else 0.0 for s, t in zip(source, tokens)])
    weights = np.where(caps > 0, tokens, 0.0)
    groups = []
    for o in others:
        names = np.array([str(c[o]) for c in cells], object)
        given, found = (marginals or {}).get(o), {n: tokens[(names == n) & (caps > 0)].sum() for n in sorted(set(names.tolist()))}
        wanted = {n: given.get(n, 0.0) if given else t for n, t in found.items()}
        groups.append((names, {n: w / max(sum(wanted.values()), 1e-300) for n, w in wanted.items()}))
    for _ in range(rounds):
        for names, wanted in groups:
            for name, share in wanted.items():
                at = names == name
                target = share * total
                if weights[at].sum() > 0:
                    weights[at] = within_caps(weights[at], caps[at], min(target, caps[at].sum()))
        was = weights.copy()
        for s, w in aim.items():
            weights[source == s] = within_caps(weights[source == s], caps[source == s], w * total)
        moved = np.abs(was - weights).sum() / total
        if moved <= 1e-9:
            break
    else:
        warnings.warn(f"raking stopped after {rounds} rounds with {moved:.2e} of the weight still moving", stacklevel=2)
    return np.where(tokens > 0, weights / np.maximum(tokens, 1e-300), 0.0), aim


def mix_sources(docs: DataFrame, targets: list[tuple[str, float, int]], others: list[str], id_: str = "doc_id", max_cells: int = 200_000, marginals: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Documents in the mix: ``id_``, ``source``, the ``others``, ``tokens``, ``copies`` (1 up to the source's most repeats).

    ``docs`` has ``id_`` (unique), ``source``, ``tokens`` and the columns ``others``, whose marginals, those in
    the corpus or shares given in ``marginals`` (a value not named there gets none), are kept as far as the
    sources allow; it is read more than once and should be cut. ``targets``
    are source, share and most repeats. A source without tokens drops out and the others keep their
    proportions; documents of other sources, and those with null or no tokens, are not used. Null in
    ``others`` is a value of its own. An empty table gives an empty mix; other columns are ignored.

    Only the tokens of each cell (source and ``others``) come to the driver, at most ``max_cells`` or it is
    an error. Within a cell, documents are taken systematically in bands of size, so shares in tokens hold
    to about a document a cell and band.
    """
    shares, repeats = {s: w for s, w, _ in targets}, {s: int(r) for s, _, r in targets}
    cell = ["source", *others]
    used = docs.where(F.col("source").isin(list(shares)) & (F.coalesce(F.col("tokens"), F.lit(0)) > 0)).select(id_, *cell, "tokens")
    sums = used.groupBy(*cell).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("__n")).limit(max_cells + 1).collect()
    if len(sums) > max_cells:
        raise ValueError(f"more than {max_cells} cells of {cell}")
    cells = [r.asDict() for r in sums]
    copies, _ = rake(cells, shares, repeats, others, marginals=marginals)
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"__c{i} {kinds[c]}" for i, c in enumerate(cell)) + ", rate double"
    rates = spark.createDataFrame([(*[c[k] for k in cell], float(x)) for c, x in zip(cells, copies)], schema)
    same = [F.col(c).eqNullSafe(F.col(f"__c{i}")) for i, c in enumerate(cell)]
    banded = used.join(rates, same).drop(*[f"__c{i}" for i in range(len(cell))]).withColumn("band", F.floor(F.log2("tokens") * 8))
    ranked = spread_rank(banded, [*cell, "band"], [F.col("tokens"), F.col(id_)], id_, buckets=max(1, -(-max((c["__n"] for c in cells), default=0) // 50_000)))
    # Every band starts at a place of its own, so rounding doesn't lean one way.
    start = F.pmod(F.xxhash64(*cell, "band"), F.lit(1 << 20)) / float(1 << 20)
    count = F.floor(start + F.col("rate") * (F.col("rank") + 1) + 1e-9) - F.floor(start + F.col("rate") * F.col("rank") + 1e-9)
    return ranked.select(id_, *cell, "tokens", count.cast("int").alias("copies")).where("copies > 0")


def share_report(mix: DataFrame, targets: list[tuple[str, float, int]]) -> DataFrame:
    """For each source: its target and actual share of the mix's tokens, documents, and the most copies of one."""
    aims = mix.sparkSession.createDataFrame([(s, float(w), int(r)) for s, w, r in targets], "source string, target_share double, max_repeat int")
    own = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    total = own.agg(F.sum("tokens").alias("all"))
    joined = aims.join(own, "source", "left").crossJoin(F.broadcast(total))  # one row
    return joined.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"),
                         F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), "max_repeat", F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
