"""Personal data by weak supervision, with DataFrame functions alone.

Candidates are the matches of the base patterns of four kinds (email, ip, card, phone), those that fail their kind's check
included, and the matches of a wider pattern of each kind: written-out addresses, IPv6, 13 to 15 digits that pass Luhn,
and telephone numbers without a plus. Labelers vote on each:
* form: for what passes the base check, against what fails it, none on wider matches;
* check: a Luhn sum, digits or parts as the kind has them;
* gazetteer: top-level domains, card issuers, country or area codes, address blocks;
* near: words before it that speak of the kind; far: words before it that speak of something else.
Votes and a few traits of shape make a code below CODES, so that the corpus is counted into at most CODES numbers.
From those, expectation-maximisation estimates the labelers' reliabilities per kind and each code's probability, and a
logistic regression on the same traits, trained on those probabilities, is the final span classifier.

Base spans always stay. A wider span is added if the classifier gives it MIN_PROBABILITY and if it meets no base span. Null text is empty and has no spans; repeated rows, null ids and
empty tables are plain cases, and texts of any length are searched whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty
from .spans import before, spans

KINDS = ("email", "ip", "card", "phone")
MIN_PROBABILITY = 0.9

# The base patterns, with possessive parts where nothing after them could want their characters back. A match can only
# start where a run starts, or where the match before it ended.
_LOCAL = "A-Za-z0-9._%+-"
BASE = (
    rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    r"[0-9](?:[\x20-]?[0-9]){15,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
WIDE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[{]\x20?(?i:at)\x20?[)\]}]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[(\[{]\x20?(?i:dot)\x20?[)\]}]\x20?[A-Za-z0-9-]{1,63}+|\.[A-Za-z0-9-]{1,63}+)++",
    r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    r"(?<![0-9.,+-])(?<![0-9][\x20])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20.,-]?[0-9])",
    r"(?<![0-9+().-])(?<![0-9][\x20])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![\x20.-]?[0-9])",
)
# Fixed values of the gazetteers and context words.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|uk|de|fr|es|it|nl|eu|us|ca|au|ch|at|be|br|cn|in|jp|ru|se|no|pl|pt|mx"
NEAR = ("e-?mail|mail|contact|write|address|correo|adresse", "ip|host|server|address|login|client|addr", "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta", "phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|llamar|appelez")
FAR = "version|isbn|issn|doi|order|invoice|page|chapter|section|article|serial|part|build|release|pages|vol|no"

#: kind 4, form 3, check 2, gazetteer 3, near 2, far 2, length 3, separators 2, wider 2.
RADIX = (4, 3, 2, 3, 2, 2, 3, 2, 2)
CODES = int(np.prod(RADIX))


def _luhn(value: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", ""))


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def passes(kind: int, value: Column) -> Column:
    """The base check of a kind."""
    if kind == 1:
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{0,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == 2:
        return _digits(value).between(16, 19) & _luhn(value)
    return _digits(value).between(8, 15) if kind == 3 else F.lit(True)


def _check(kind: int, value: Column) -> Column:
    if kind == 2:
        return _luhn(value)
    return {0: value.rlike("[A-Za-z]{2,}$"), 1: F.length(value).between(7, 45), 3: _digits(value).between(10, 15)}[kind]


def _gazetteer(kind: int, value: Column) -> Column:
    """0 against, 1 no vote, 2 for."""
    good, bad = {
        0: (value.rlike(rf"(?i)[.)\]}}]\x20?(?:{DOMAINS})$"), value.rlike(r"(?i)\.(?:png|jpe?g|gif|svg|css|js|html?|txt|zip)$")),
        1: (value.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|^[23][0-9A-Fa-f]{3}:"), value.rlike(r"^0+\.|^[0-9]\.[0-9]\.")),
        2: (value.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|3[068])"), value.rlike("^[01789]")),
        3: (value.rlike(r"^\+(?:1|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}"), value.rlike(r"^\(?[01][0-9]{2}")),
    }[kind]
    return F.when(good & ~bad, 2).when(bad, 0).otherwise(1)


def _code(kind: int, wide: bool, value: Column, context: Column, base: Column) -> Column:
    length = F.when(F.length(value) < 12, 0).when(F.length(value) < 18, 1).otherwise(2)
    digits = [F.lit(kind), F.lit(1) if wide else F.when(base, 2).otherwise(0), _check(kind, value).cast("int"), _gazetteer(kind, value), context.rlike(rf"(?i)\b(?:{NEAR[kind]})\b[^A-Za-z]*(?:[A-Za-z]+[^A-Za-z]+){{0,2}}$").cast("int"), context.rlike(rf"(?i)\b(?:{FAR})\b[^A-Za-z]*$").cast("int"), length, value.rlike(r"[\x20()\[\]{}-]").cast("int"), F.lit(int(wide))]
    out = F.lit(0)
    for digit, radix in zip(digits, RADIX, strict=True):
        out = out * radix + F.coalesce(digit, F.lit(0))
    return out.cast("int")


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, wide): for each row, the base spans that pass and all other candidates, with kind, start, end, code."""
    t = F.col("t")
    might = (t.contains("@"), t.contains("."), None, t.contains("+"), t.rlike(r"(?i)[(\[{]\x20?at\x20?[)\]}]"), t.contains(":"), None, None)
    found = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text).alias("t"))
    found = found.select("doc_id", "t", *[spans(t, p, m).alias(f"m{k}") for k, (p, m) in enumerate(zip((*BASE, *WIDE), might, strict=True))])

    def coded(k: int) -> Column:
        kind, wide = k % 4, k >= 4

        def one(m: Column) -> Column:
            base = F.lit(False) if wide else F.coalesce(passes(kind, m["value"]), F.lit(False))
            return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), base.alias("base"), _code(kind, wide, m["value"], before(t, m["start"], 40), base).alias("code"))

        return F.transform(F.col(f"m{k}"), one)

    return found.select("doc_id", F.concat(*[coded(k) for k in range(8)]).alias("spans"))


def _traits(codes: np.ndarray) -> np.ndarray:
    out = np.empty((len(codes), len(RADIX)), dtype=np.int64)
    rest = codes.copy()
    for k in reversed(range(len(RADIX))):
        out[:, k], rest = rest % RADIX[k], rest // RADIX[k]
    return out


def reliabilities(traits: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Each code's probability of being personal data, by expectation-maximisation over the five labelers' votes, per kind."""
    out = np.full(len(counts), 0.5)
    for kind in range(len(KINDS)):
        own = traits[:, 0] == kind
        if not own.any():
            continue
        votes, n = traits[own][:, 1:6], counts[own]
        sizes = RADIX[1:6]
        # Start: a labeler that speaks for or against is right in four of five cases; near only speaks for, far only against.
        lean = np.array([votes[:, 0] - 1, 2 * votes[:, 1] - 1, votes[:, 2] - 1, votes[:, 3], -votes[:, 4]]).sum(axis=0)
        p = 1 / (1 + np.exp(-lean * np.log(4)))
        for _ in range(rounds):
            share = np.clip((n * p).sum() / n.sum(), 1e-3, 1 - 1e-3)
            logit = np.full(len(n), np.log(share / (1 - share)))
            for j, size in enumerate(sizes):
                yes = np.bincount(votes[:, j], n * p, size) + 1
                no = np.bincount(votes[:, j], n * (1 - p), size) + 1
                logit += np.log(yes / yes.sum())[votes[:, j]] - np.log(no / no.sum())[votes[:, j]]
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        out[own] = p
    return out


def classifier(traits: np.ndarray, counts: np.ndarray, target: np.ndarray, steps: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Each code's probability by a logistic regression on one-hot traits, with rows weighted by their counts (Newton's steps)."""
    x = np.concatenate([np.ones((len(traits), 1)), *[np.eye(r)[traits[:, k]] for k, r in enumerate(RADIX)]], axis=1)
    w, weight = np.zeros(x.shape[1]), counts / counts.mean()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (target - p)) - ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(curve, slope)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def accepted(counts: dict[int, int]) -> list[int]:
    """The codes of wider spans that the classifier accepts."""
    if not counts:
        return []
    codes = np.array(sorted(counts))
    n = np.array([counts[c] for c in codes.tolist()], dtype=float)
    traits = _traits(codes)
    p = classifier(traits, n, reliabilities(traits, n))
    return codes[(traits[:, 8] == 1) & (p >= MIN_PROBABILITY)].tolist()


def _written(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) for every row.

    The counts and base_sha256 are of the base spans, spans has the added ones too. Candidates are found once and written,
    without texts; the second pass reads those alone.
    """
    rows = cut(candidates(docs, id_col, text), "pii-candidates")
    counted = rows.select(F.explode("spans.code").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    good = accepted({r["code"]: r["n"] for r in counted.collect()})  # at most CODES rows
    base = F.filter("spans", lambda s: s["base"])
    open_ = F.filter("spans", lambda s: s["code"].isin(good)) if good else F.filter("spans", lambda s: F.lit(False))
    out = rows.select("doc_id", base.alias("base"), open_.alias("open"))
    added = F.filter("open", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    out = out.select("doc_id", "base", added.alias("added"))

    def order(found: Column) -> Column:
        return F.array_sort(F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    return out.select("doc_id", *counts, F.sha2(_written(order(F.col("base"))), 256).alias("base_sha256"), _written(order(F.concat("base", "added"))).alias("spans"), F.size("added").cast("bigint").alias("n_added"))
