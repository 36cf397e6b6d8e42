"""Personal data: base patterns plus gradient-boosted candidates.

Two high-recall generators propose overlapping spans: loose numbers and loose
mail addresses. Each candidate is described by a few discrete format and
context features. Boosted trees of depth 2 learn on a fixed labelled set
(``labelled``: formats after words that speak for personal data, against it
and neither), which does not depend on the base patterns, and the threshold is
the lowest score at which the codes above it are personal in PRECISION of the
labelled cases. The corpus reduces to its distinct feature codes (a partial
aggregation; at most CODES rows whatever the corpus), the ones from the
threshold on are added, and the corpus is processed by built-in functions only.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from campusflow.llm import spans as S
from campusflow.llm.common import Shared

# The base patterns of the task. The search may only begin where
# a run begins or the last match ended, and runs are possessive: the same
# matches without retries inside long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

KINDS = ("email", "ip", "card", "phone", "other")
NUMBER = r"(?<![0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++"
MAIL = r"(?:\G|(?<![^\s@<>()\[\]]))[^\s@<>()\[\]]++(?:@|\x20?[\[(]at[\])]\x20?)[^\s@<>()\[\]]++"
NUMBER_LEAST = 7
CONTEXT = r"(?i)\b(phone|tel|telephone|mobile|call|fax|mail|e-mail|email|contact|card|visa|iban|account|ssn|ip|address|telefon|appel|correo|tarjeta)\b"
AROUND = 24

#: Words after which a number is something else; the last word of both decides.
AGAINST = r"(?i)\b(order|invoice|item|ref|reference|number|no|id|sku|isbn|serial|version|ticket|part|tracking|article|lot|model|build|page|total|commande|pedido|bestellung)\b"
SSN = r"^\(?[0-9]{3}-[0-9]{2}-[0-9]{4}$"
NATIONAL = r"^\(?[0-9]{3}(?:\)[\x20-]?|[.-])[0-9]{3}[.-][0-9]{4}$"
DATE = r"^\(?(?:(?:19|20)[0-9]{2}([.-])[0-9]{2}\1[0-9]{2}|[0-9]{2}([.-])[0-9]{2}\2(?:19|20)[0-9]{2})(?![0-9])"

#: Sizes of the features, in order; a code is their mixed-radix number. mail: no,
#: with @, with [at]; shape: no blank, any, SSN, national phone, date; joined:
#: no, to letters or digits, to the country letters of an IBAN.
RADIX = {"mail": 3, "digits": 6, "plus": 2, "paren": 2, "dot": 2, "shape": 5, "luhn": 2, "context": 2, "joined": 3, "against": 2}
CODES = int(np.prod(list(RADIX.values())))
ROUNDS = 60
RATE = 0.3
PRECISION = 0.98


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    size = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(F.pmod(size - i, F.lit(2)) == 1, twice).otherwise(d)

    places = F.sequence(F.lit(1), F.greatest(size, F.lit(1)))
    total = F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return (size > 0) & (F.pmod(total, F.lit(10)) == 0)


def _byte_parts(hit: Column) -> Column:
    parts = F.transform(F.split(hit, "[.]"), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _is_card(hit: Column) -> Column:
    digits = _digits(hit)
    return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)


def base_spans(text: Column) -> list[Column]:
    """The base spans of each kind, as arrays of (start, end, hit, part)."""
    return [
        S.matches(text, EMAIL),
        S.matches(text, IP, 0, lambda hit, _: _byte_parts(hit)),
        S.matches(text, CARD, 0, lambda hit, _: _is_card(hit)),
        S.matches(text, PHONE, 0, lambda hit, _: F.length(_digits(hit)).between(10, 15)),
    ]


def _code(values: dict[str, Column]) -> Column:
    code = F.lit(0)
    for name, size in RADIX.items():
        code = code * size + values[name].cast("int")
    return code


def _last(text: Column, words: str) -> Column:
    """Where the last of the words ends (0 without any)."""
    return F.length(F.regexp_extract(text, r"(?s)^.*" + words, 0))


def _features(text: Column, s: Column, mail: bool) -> Column:
    hit, digits = s["hit"], _digits(s["hit"])
    n = F.length(digits)
    before = F.substring(text, F.greatest(s["start"] - AROUND + 1, F.lit(1)), F.least(s["start"], F.lit(AROUND)))
    after = F.substring(text, s["end"] + 1, F.lit(1))
    against = _last(before, AGAINST)
    iban = n.between(12, 30) & before.rlike(r"(?<![A-Za-z0-9])[A-Z]{2}$") & ~after.rlike(r"^[a-z0-9_]")
    return _code({
        "mail": F.when(F.lit(not mail), 0).when(hit.contains("@"), 1).otherwise(2),
        "digits": F.when(n < 9, 0).when(n < 10, 1).when(n < 11, 2).when(n < 14, 3).when(n < 20, 4).otherwise(5),
        "plus": hit.startswith("+"),
        "paren": hit.contains(")"),
        "dot": hit.rlike(r"\.[A-Za-z0-9]"),
        "shape": F.when(hit.rlike(SSN), 2).when(hit.rlike(NATIONAL), 3).when(hit.rlike(DATE), 4).when(hit.rlike(r"[\x20-]"), 1).otherwise(0),
        "luhn": F.when(n.between(14, 19), luhn(digits)).otherwise(False),
        "context": before.rlike(CONTEXT) & (against < _last(before, CONTEXT)),
        "joined": F.when(iban, 2).when(before.rlike(r"[A-Za-z0-9_]$") | after.rlike(r"^[A-Za-z0-9_]"), 1).otherwise(0),
        "against": before.rlike(AGAINST) & (against > _last(before, CONTEXT)),
    })


#: Formats of the labelled set (d is a digit): personal by themselves, only
#: after a word of CONTEXT, and never; decimal numbers, never without one.
CLEAR = ["ddd-dd-dddd", "(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "+dd ddd ddddddd", "+d (ddd) ddd-dddd", "DEdd dddd dddd dddd dddd dd", "FRdd dddd dddd dddd dddd dddd ddd", "NOdd dddd dddd ddd", "ESdddddddddddddddddddddd"]
TOLD = ["ddd ddd dddd", "dddddddddd", "0ddd ddddddd", "0dddddddddd", "ddd-dddd", "ddd dddd", "dddddddd", "0d dd dd dd dd", "0d.dd.dd.dd.dd", "ddd dd dddd", "ddddddddd", "dddd ddd ddd ddd", "4dddddddddddd", "dddd dddd dddd dddd", "dddddddddddddddd", "dddddddddddddddddddd"]
NEVER = ["20dd-dd-dd", "20dd.dd.dd", "dd.dd.20dd", "20dd-dd-dd dd", "xdddddddd", "dddddddddddx", "v_dddddddddd", "Xddd-dd-ddddx", "x-ddd-dddd-ddddz"]
DECIMALS = ["d.ddddddddd", "dddd.dddddd", "d.dddddddd", "dd.dddddd", "ddd.dddddddddd"]
MAILS = ["ann.lee [at] example.org", "bob(at)mail.example.com", "c.d [at] uni.example", "e_f[at]example.net", "josé@exämple.de", "x.y@example.org"]
NO_MAILS = ["meet [at] noon", "see(at)home", "look@me", "7@once", "user@host", "a [at] b"]
FOR = ["phone ", "call me: ", "tel. ", "my mobile is ", "fax ", "card ", "account ", "IBAN ", "SSN: ", "contact: "]
NEITHER = ["", "we had ", "and then ", "of ", "about ", "le mot ", "size ", "und ", "(", "some "]
OTHERWISE = ["order ", "invoice no. ", "item ", "ref: ", "serial ", "ticket id ", "order number ", "tracking ", "ISBN ", "part "]


def labelled(seed: int = 7) -> list[tuple[str, bool]]:
    """(text with one candidate, whether it is personal data)."""
    rng = random.Random(seed)
    out = []
    for formats, told, clear in ((CLEAR, True, True), (TOLD, True, False), (NEVER, False, False)):
        for words, label in ((FOR, told), (NEITHER, clear), (OTHERWISE, False)):
            # A country's letters and a plus say more than any word before them.
            out += [
                (w + "".join(rng.choice("123456789") if c == "d" else c for c in f) + " end", label or (clear and (f[0] == "+" or f[1].isupper())))
                for f in formats for w in words
            ]
    out += [(w + "".join(rng.choice("123456789") if c == "d" else c for c in f) + " end", False) for f in DECIMALS for w in NEITHER + OTHERWISE]
    return out + [(w + m + " end", label) for w in FOR + NEITHER for mails, label in ((MAILS, True), (NO_MAILS, False)) for m in mails]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, ``base`` (sorted tagged spans) and ``proposed``:
    (start, end, code, confirmed) of every generated candidate."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    email, ip, card, phone = base_spans(text)
    found = docs.select(
        "doc_id", text.alias("_text"), email.alias("_email"), ip.alias("_ip"), card.alias("_card"), phone.alias("_phone"),
        S.matches(text, NUMBER, 0, lambda hit, _: F.length(_digits(hit)) >= NUMBER_LEAST).alias("_number"),
        S.matches(text, MAIL).alias("_mail"),
    )
    tags = [S.tagged(F.col(f"_{k}"), i) for i, k in enumerate(KINDS[:4])]
    found = found.withColumn("base", F.array_sort(F.concat(*tags)))

    def described(spans: str, mail: bool) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"),
                _features(F.col("_text"), s, mail).alias("code"),
                F.exists("base", lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])).alias("confirmed"),
            ),
        )

    return found.select(
        "doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]], "base",
        F.concat(described("_number", False), described("_mail", True)).alias("proposed"),
    )


def feature_table() -> np.ndarray:
    """The feature values of every code."""
    return np.stack(np.unravel_index(np.arange(CODES), list(RADIX.values())), axis=1)


def boost(confirmed: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Probability of every code, by gradient boosting (logistic loss, Newton
    leaves, trees of depth 2) on the counts of personal and all candidates."""
    x = feature_table()
    splits = [(f, v) for f in range(x.shape[1]) for v in range(1, x[:, f].max() + 1)]
    sides = np.array([x[:, f] >= v for f, v in splits])
    prior = (confirmed.sum() + 0.5) / (total.sum() + 1.0)
    score = np.full(len(x), np.log(prior / (1 - prior)))

    def best(mask: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The side of the split of the masked codes that gains most."""
        right_g, right_h = sides @ (g * mask), sides @ (h * mask)
        all_g, all_h = (g * mask).sum(), (h * mask).sum()
        gain = right_g**2 / (right_h + 1) + (all_g - right_g) ** 2 / (all_h - right_h + 1)
        return sides[int(np.argmax(gain))]

    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        g, h = confirmed - total * p, total * p * (1 - p)
        top = best(np.ones(len(x)), g, h)
        for part in (top, ~top):
            inner = best(part, g, h)
            for leaf in (part & inner, part & ~inner):
                score[leaf] += RATE * g[leaf].sum() / (h[leaf].sum() + 1)
    return 1 / (1 + np.exp(-score))


def calibrate(score: np.ndarray, confirmed: np.ndarray, total: np.ndarray) -> float:
    """The lowest score such that the candidates from it on are confirmed in
    PRECISION of the cases; above 1 if there is none."""
    order = np.argsort(-score, kind="stable")
    hits, seen = np.cumsum(confirmed[order]), np.cumsum(total[order])
    good = np.flatnonzero((seen > 0) & (hits >= PRECISION * seen) & (np.append(score[order][1:], -1) < score[order]))
    return float(score[order][good[-1]]) if len(good) else 2.0


def model(spark: SparkSession) -> tuple[np.ndarray, float]:
    """The score of every code and the threshold, from the labelled set."""
    rows = [(2 * i + label, text) for i, (text, label) in enumerate(labelled())]
    seen = candidates(spark.createDataFrame(rows, "doc_id long, text string"))
    personal, total = np.zeros(CODES), np.zeros(CODES)
    for r in seen.select("doc_id", F.explode("proposed.code").alias("code")).collect():
        personal[r["code"]] += r["doc_id"] % 2
        total[r["code"]] += 1
    score = boost(personal, total)
    return score, calibrate(score, personal, total)


def report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_email, n_ip, n_card, n_phone,
    base_sha256 (of the base spans' digest), spans (the digest of all spans)
    and n_other, the candidates that the trees add outside of base spans (of
    overlapping ones the best, then the first).

    Null texts count as empty; repeated rows give a row each; an empty table
    gives an empty result; other columns are ignored.
    """
    found = Shared(spark, "pii").table(candidates(docs))
    score, least = model(spark)
    # Each candidate outside of base spans has a code; few of all codes occur.
    loose = F.filter("proposed", lambda c: ~c["confirmed"])
    codes = found.select(F.explode(loose).alias("p")).select("p.code").distinct().collect()
    added = sorted((r["code"] for r in codes if score[r["code"]] >= least), key=lambda c: (-score[c], c))
    rank = F.create_map(*[F.lit(x) for c in added for x in (c, -float(score[c]))]) if added else None
    scored = F.transform(
        F.filter(loose, lambda c: c["code"].isin(added) if added else F.lit(False)),
        lambda c: F.struct((F.element_at(rank, c["code"]) if added else F.lit(0.0)).alias("rank"), c["start"].alias("start"), c["end"].alias("end")),
    )
    chosen = found.withColumn("_chosen", F.array_sort(scored))
    alone = F.filter(
        "_chosen",
        lambda c: ~F.exists("_chosen", lambda o: (o < c) & (o["start"] < c["end"]) & (c["start"] < o["end"])),
    )
    chosen = chosen.withColumn("_other", S.tagged(alone, 4))
    return chosen.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(S.digest(F.col("base"), KINDS), 256).alias("base_sha256"),
        S.digest(F.array_sort(F.concat("base", "_other")), KINDS).alias("spans"),
        F.size("_other").cast("long").alias("n_other"),
    )
