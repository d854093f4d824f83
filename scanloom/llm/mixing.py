"""Soft-membership mixing: document rates whose expected token totals per domain meet target weights.

Only DataFrame functions run on the executors; the driver solves systems as large as the number of domains.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.session import settle

BUCKETS = 1 << 16
#: Words of prior evidence: longer texts do not grow ever more certain of their domain.
TEMPER = 200.0
DOMAINS = ("good", "low", "toxic")


def domain_of_labels() -> Column:
    """Domain of a row of the labels table; NULL where the labels say nothing."""
    toxic, quality = F.col("toxic"), F.col("quality")
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "good")


def words(docs: DataFrame, *keep: str) -> DataFrame:
    """A row per word, ``bucket`` its hash; a text without words has one row with a NULL bucket."""
    text = F.trim(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    split = docs.select(*keep, F.explode_outer(F.when(text != "", F.split(text, " "))).alias("word"))
    return split.select(*keep, F.when(F.col("word").isNotNull(), F.pmod(F.xxhash64("word"), F.lit(BUCKETS))).cast("int").alias("bucket"))


def weights(docs: DataFrame, labels: DataFrame, domains: tuple[str, ...], max_rows: int) -> tuple[DataFrame, list[float]]:
    """Log-likelihood of every word bucket in each domain (``BUCKETS`` rows at most) and the domains' log priors.

    At most about ``max_rows`` labelled documents, chosen by a hash of the id, teach them. An id with several
    labels has the domain that comes first by name.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("domain").isin(*domains)).groupBy(F.col("doc_id").cast("bigint").alias("id")) \
        .agg(F.min("domain").alias("domain"))
    known = settle(known)
    share = min(1.0, 0.97 * max_rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * share))
    # chosen has max_rows rows at most.
    taught = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(F.broadcast(chosen), "id")
    # The priors are those of the documents at hand: a domain that an earlier stage removed has next to none.
    sizes = {r["domain"]: r["n"] for r in taught.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    priors = [math.log((sizes.get(d, 0) + 1) / (total + len(domains))) for d in domains]
    counts = settle(words(taught, "domain").where("bucket is not null").groupBy("bucket").agg(
        *[F.sum((F.col("domain") == d).cast("int")).alias(f"n{k}") for k, d in enumerate(domains)]
    ))
    sums = counts.agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(len(domains))]).first()
    # A bucket's share in a domain is drawn to its share in all domains by one word's worth.
    everything = sum(sums) or 1
    share_of_all = sum(F.col(f"n{k}") for k in range(len(domains))) / everything
    logs = [(F.log((F.col(f"n{k}") + share_of_all) / (sums[k] + 1)) - F.log(share_of_all)).alias(f"w{k}") for k in range(len(domains))]
    return counts.select("bucket", *logs), priors


def memberships(docs: DataFrame, table: DataFrame, priors: list[float]) -> DataFrame:
    """doc_id, n_tokens (words) and the posteriors p0, p1, ... of every row of ``docs``."""
    domains = range(len(priors))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = words(rows, "uid", "doc_id").join(F.broadcast(table), "bucket", "left")  # BUCKETS rows at most
    summed = scored.groupBy("uid", "doc_id").agg(
        F.count("bucket").alias("n_tokens"), *[F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"s{k}") for k in domains]
    )
    logit = [F.lit(priors[k]) + F.col(f"s{k}") * TEMPER / (TEMPER + F.col("n_tokens")) for k in domains]
    top = F.greatest(*logit) if len(priors) > 1 else logit[0]
    odds = summed.select("uid", "doc_id", "n_tokens", *[F.exp(x - top).alias(f"e{k}") for k, x in enumerate(logit)])
    total = sum(F.col(f"e{k}") for k in domains)
    return odds.select("uid", "doc_id", "n_tokens", *[(F.col(f"e{k}") / total).alias(f"p{k}") for k in domains])


def rates(members: DataFrame, targets: list[float], tolerance: float = 1e-4, rounds: int = 60) -> DataFrame:
    """Adds ``rate`` >= 0 such that the rate-weighted expected tokens of each domain meet ``targets``.

    Projected gradient descent on the squared relative misses, from rates of one. Misses are measured in the metric of
    the Gram matrix of the documents whose rate is not at its bound, in which a step of one is right however unequal
    the domains are; a round that made the worst miss larger halves the later steps. A round is one aggregation of a few
    sums; every tenth writes the rates, so plans stay short. A domain that cannot be met (no tokens, or only together
    with another's) is met as nearly as the method gets.
    """
    k = len(targets)
    scaled = [F.col("n_tokens") * F.col(f"p{i}") / max(t, 1e-9) for i, t in enumerate(targets)]
    rows = members.withColumns({f"b{i}": x for i, x in enumerate(scaled)}).withColumn("rate", F.lit(1.0))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rate, before, length = F.col("rate"), math.inf, 1.0
    for step in range(1, rounds + 1):
        free = (rate > 0).cast("double")
        totals = [F.sum(F.col(f"b{i}") * rate) for i in range(k)] + [F.sum(F.col(f"b{i}") * F.col(f"b{j}") * free) for i, j in pairs]
        got = [x or 0.0 for x in rows.agg(*totals).first()]
        pull, worst = descent(got[:k], got[k:], [float(t > 0) for t in targets])
        if worst <= tolerance or abs(before - worst) < tolerance / 100:
            break
        length = length / 2 if worst > before else length
        before = worst
        rate = F.greatest(F.lit(0.0), rate - sum(F.col(f"b{i}") * float(length * pull[i]) for i in range(k)))
        if step % 10 == 0:
            rows, rate = settle(rows.withColumn("rate", rate)), F.col("rate")
    return rows.withColumn("rate", rate).drop(*[f"b{i}" for i in range(k)])


def descent(sums: list[float], products: list[float], wanted: list[float]) -> tuple[np.ndarray, float]:
    """Per domain the pull on its documents, and the worst miss. ``products`` is the Gram matrix's upper triangle by rows."""
    k = len(sums)
    gram = np.zeros((k, k))
    gram[np.triu_indices(k)] = products
    gram += np.triu(gram, 1).T
    miss = np.array(sums) - np.array(wanted)
    return np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ miss, float(np.abs(miss).max(initial=0))


def bounded_rates(members: DataFrame, share: list[float], tolerance: float = 1e-3, rounds: int = 40) -> DataFrame:
    """Adds ``rate`` between 0 and 1, as near to 1 as can be, such that no domain has more than its share next to the first.

    The projection of rates of one: a document's rate is 1 less its surplus tokens times a price per domain, cut to [0, 1];
    surplus is what it has of a domain beyond that domain's share of its tokens of the first. Newton's method finds the
    prices; a round is one aggregation of a few sums. A domain with a price meets its share; one without has less than
    its share at hand, and nothing of it is given up for its own sake.
    """
    k = len(share)
    first = F.col("n_tokens") * F.col("p0")
    rows = members.withColumns({f"b{i}": F.col("n_tokens") * F.col(f"p{i}") - first * (share[i] / share[0]) for i in range(1, k)})

    def raw(prices):
        return F.lit(1.0) - sum((F.col(f"b{i}") * float(prices[i - 1]) for i in range(1, k)), F.lit(0.0))

    pairs = [(i, j) for i in range(1, k) for j in range(i, k)]
    prices, best, least = np.zeros(k - 1), np.zeros(k - 1), math.inf
    for _ in range(rounds if k > 1 else 0):
        at = raw(prices)
        rate, free = F.least(F.lit(1.0), F.greatest(F.lit(0.0), at)), ((at > 0) & (at <= 1)).cast("double")
        sums = [F.sum(F.col(f"b{i}") * rate) for i in range(1, k)] + [F.sum(F.col(f"b{i}") * F.col(f"b{j}") * free) for i, j in pairs]
        got = [x or 0.0 for x in rows.agg(F.sum(first * rate), *sums).first()]
        over = np.array(got[1:k])
        miss = over / np.maximum(1e-9, np.array([x / share[0] for x in share[1:]]) * max(got[0], 1.0))
        miss = np.where((prices > 0) | (over > 0), np.abs(miss), 0.0)
        worst = float(miss.max(initial=0))
        if worst < least:
            best, least = prices, worst
        if worst <= tolerance:
            break
        if worst > 2 * least:
            prices = (prices + best) / 2
            continue
        gram = np.zeros((k - 1, k - 1))
        gram[np.triu_indices(k - 1)] = got[k:]
        gram += np.triu(gram, 1).T
        on = np.flatnonzero((prices > 0) | (over > 0))
        step = np.zeros(k - 1)
        step[on] = np.linalg.pinv(gram[np.ix_(on, on)], rcond=1e-9, hermitian=True) @ over[on]
        if not step.any():  # every rate is at a bound
            step = prices * np.where(over > 0, 0.5, -0.25)
        prices = np.maximum(0.0, prices + step)
    rate = F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw(best)))
    return rows.withColumn("rate", rate).drop(*[f"b{i}" for i in range(1, k)])


def mix(docs: DataFrame, labels: DataFrame, target: dict[str, float], budget: float | None = None, headroom: float | None = None,
        max_rows: int = 50_000, at_most_once: bool = False) -> DataFrame:
    """Rate of every document in a mixture of domains.

    ``docs`` needs doc_id and text, ``labels`` doc_id and domain; other columns are ignored. ``target`` gives the domains
    and their weights. The mixture has ``budget`` tokens (default: as many as there are), or with ``headroom`` as many
    that the first domain's documents come to that multiple of what there is of them; then no other domain is asked
    for more than there is of it. With ``at_most_once`` rates are at most 1 and the budget follows: as much as the weights
    allow (``bounded_rates``). Returns per input row doc_id,
    n_tokens, p_<domain> and rate, the expected number of copies. NULL and empty texts have no tokens, the prior as
    posterior and rate 1; repeated rows and NULL ids get rates like any other row; without labels all domains are
    alike; an empty table gives an empty result.
    """
    domains = tuple(target)
    table, priors = weights(docs, labels, domains, max_rows)
    members = settle(memberships(docs, table, priors))
    share = [target[d] / sum(target.values()) for d in domains]
    if at_most_once:
        return named(bounded_rates(members, share), domains)
    have = [x or 0.0 for x in members.agg(*[F.sum(F.col("n_tokens") * F.col(f"p{k}")) for k in range(len(domains))]).first()]
    if headroom is None:
        wanted = [(sum(have) if budget is None else budget) * s for s in share]
    else:
        wanted = [headroom * have[0]] + [min(headroom * have[0] * s / share[0], h) for s, h in zip(share[1:], have[1:])]
    return named(rates(members, wanted), domains)


def named(rows: DataFrame, domains: tuple[str, ...]) -> DataFrame:
    return rows.select("doc_id", "n_tokens", *[F.col(f"p{k}").alias(f"p_{d}") for k, d in enumerate(domains)], "rate")
