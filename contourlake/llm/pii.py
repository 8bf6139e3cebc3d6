"""Personal data: labelers vote on candidate spans, EM weighs the votes, a span classifier decides.

Candidates are the spans of strict patterns (base spans: these always stay) and of looser ones: digit
runs that fail the card checksum, phone numbers without a country code, obfuscated e-mail addresses,
long hexadecimal secrets and names. A format, a gazetteer and a context labeler vote for, against or not
at all, each by its own evidence: checksums and shapes; lists of endings, issuers, countries and names; the words in front. Expectation-maximisation (for each kind a prior and one table of vote probabilities per labeler and
truth) turns the counts of vote patterns into reliabilities and soft labels, and a logistic regression on
votes, kind, length and position is fitted to these. Both models are fitted on counts over all
documents; only those counts (at most a few hundred rows) come to the driver.

Everything on rows is built-in expressions. Positions are code points, ends exclusive; they come from
splitting the text at the matches and adding up lengths, so a long text is never cut once per match.

Edge cases: a null text is empty and has no spans; repeated rows are judged each; without any candidate
nothing is fitted and only base spans count; empty tables give empty results; extra columns are kept where asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contourlake.llm.rules import let

KINDS = ("email", "ip", "card", "phone", "secret", "name")

# Patterns. Possessive and anchored forms of the plain ones, so that runs are read once and groups need no stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
LOCAL_PHONE = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
VEILED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}+(?![0-9A-Za-z])"
GIVEN = "James|John|Robert|Michael|David|William|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Hans|Peter|Klaus|Ursula|Monika|Jean|Pierre|Marie|Camille|Juan|Carlos|Carmen|Ana"
NAME = rf"(?<![A-Za-z])(?:(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20|(?:{GIVEN})\x20)[A-Z][a-z]++(?:\x20[A-Z][a-z]++)?"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
CUES = r"(?i)(?:e-?mail|contact|write to|reach|call|phone|tel|fax|mobile|host|server|address|client|card|visa|master|payment|account|token|secret|key|password|name|author|by|from|sincerely)\W*+$"
AGAINST = r"(?i)(?:version|release|isbn|issn|order|item|page|chapter|section|serial|model|commit|sha|md5|checksum)\W*+$"
DOMAINS = r"(?i)(?:\.|dot[)\]]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|ch|at)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
COUNTRIES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def weigh(i):
        x = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), weigh), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _gazetteer(kind: str, m: Column) -> Column:
    """What lists say of a match: 1, -1, or 0 for nothing."""
    return {
        "email": F.when(m.rlike(DOMAINS), 1).otherwise(0),
        "ip": F.when(m.rlike(r"^(?:0|127|255)\.|\.0$"), -1).otherwise(0),
        "card": F.when(_digits(m).rlike(ISSUERS), 1).otherwise(-1),
        "phone": F.when(m.rlike(COUNTRIES), 1).otherwise(0),
        "secret": F.when(F.size(F.array_distinct(F.split(m, ""))) >= 10, 0).otherwise(-1),
        "name": F.when(m.rlike(rf"(?:^|\x20)(?:{GIVEN})\x20"), 1).otherwise(0),
    }[kind]


def running(values: Column, join) -> Column:
    """The running sums (or what else ``join`` joins, starting from 0) of an array of longs.

    Spark's aggregate copies an array to append to it, so the array is cut into blocks of about the root of its size.
    """
    return let(values, lambda v: _running(v, join))


def _running(values: Column, join) -> Column:
    n = F.size(values)
    block = F.ceil(F.sqrt(n)).cast("int")
    start = F.struct(F.lit(0).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("all"))

    def step(acc, x):
        return F.struct(join(acc["last"], x).alias("last"), F.array_append(acc["all"], join(acc["last"], x)).alias("all"))

    inner = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.aggregate(F.slice(values, b * block + 1, block), start, step, lambda acc: acc["all"]))
    before = lambda blocks: F.aggregate(F.transform(blocks, lambda p: F.element_at(p, -1)), start, step, lambda acc: F.concat(F.array(F.lit(0).cast("bigint")), acc["all"]))
    joined = lambda blocks: F.flatten(F.zip_with(blocks, F.slice(before(blocks), F.lit(1), F.size(blocks)), lambda p, c: F.transform(p, lambda x: join(c, x))))
    return F.when(n > 0, let(inner, joined)).otherwise(F.array().cast("array<bigint>"))


_SPAN = "array<struct<start:bigint,kind:int,end:bigint,base:boolean,format:int,gazetteer:int,context:int,line:int,size:int>>"


def _spans(text: Column, kind: str, pattern: str, hint: Column, good, form, base: bool) -> Column:
    """All matches of a pattern as spans with votes. ``good`` checks a match of a base kind, ``form`` is the format labeler's vote; ``hint`` is a cheap condition that a match needs."""

    def found(pieces, matches):
        both = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(p.alias("piece"), m.alias("m")))
        ends = running(F.transform(both, lambda x: (F.length(x["piece"]) + F.length(x["m"])).cast("bigint")), lambda a, x: a + x)
        return F.zip_with(both, ends, span)

    def span(x, end):
        m, before = x["m"], F.right(x["piece"], F.lit(32))
        fits = good(m)
        votes = (form(m, fits), _gazetteer(kind, m), F.when(before.rlike(CUES), 1).when(before.rlike(AGAINST), -1).otherwise(0))
        return F.struct((end - F.length(m)).cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.cast("long").alias("end"), (fits if base else F.lit(False)).alias("base"), *(v.cast("int").alias(n) for v, n in zip(votes, ("format", "gazetteer", "context"))), F.when((before == "") | before.rlike(r"\n\s*$"), 1).otherwise(0).alias("line"), F.least(F.length(m) / 8, F.lit(5)).cast("int").alias("size"))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = let(matches, lambda ms: F.when(F.size(ms) > 0, let(F.split(text, pattern, -1), lambda ps: found(ps, ms))).otherwise(F.array().cast(_SPAN)))
    return F.when(hint, spans).otherwise(F.array().cast(_SPAN)).cast(_SPAN)


def candidates(text: Column) -> Column:
    """All candidate spans of a text, in order of start and kind; loose ones that touch a base span are left out."""
    text = F.coalesce(text, F.lit(""))
    digits_between = lambda lo, hi: lambda m: F.length(_digits(m)).between(lo, hi)
    yes = lambda m: F.lit(True)
    strict = lambda m, fits: F.when(fits, 1).otherwise(-1)
    dotted = lambda m, fits: F.when(m.rlike(r"(?i)[(\[]dot[)\]]|\.[a-z]{2,}$"), 1).otherwise(-1)
    even = lambda m, fits: F.when(m.rlike(r"^\([0-9]{3}\)|^[0-9]{3}([.-])[0-9]{3}\1"), 1).otherwise(0)
    keyed = lambda m, fits: F.when(F.length(m).isin(32, 40, 64) & m.rlike("[0-9]") & m.rlike("[A-Fa-f]") & ~(m.rlike("[a-f]") & m.rlike("[A-F]")), 1).otherwise(-1)
    titled = lambda m, fits: F.when(m.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof)"), 1).when(m.rlike(r"\x20[A-Z][a-z]+$"), 0).otherwise(-1)
    firm = F.concat(
        _spans(text, "email", EMAIL, text.contains("@"), yes, strict, True),
        _spans(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(OCTETS), strict, True),
        _spans(text, "card", CARD, text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]"), lambda m: luhn(_digits(m)), strict, True),
        _spans(text, "phone", PHONE, text.contains("+"), digits_between(9, 15), strict, True),
    )
    loose = F.concat(
        _spans(text, "email", VEILED_EMAIL, text.rlike(r"[(\[]at[)\]]"), yes, dotted, False),
        _spans(text, "phone", LOCAL_PHONE, text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), yes, even, False),
        _spans(text, "secret", SECRET, text.rlike(r"[0-9A-Fa-f]{32}"), yes, keyed, False),
        _spans(text, "name", NAME, text.rlike(rf"(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z]|(?:{GIVEN})\x20[A-Z]"), yes, titled, False),
    )
    return F.concat(firm, loose)


def without_overlaps(found: Column) -> Column:
    """Base spans, and the others that touch none of them; sorted.

    In the order of starts a span touches a base one before it where that one's end, and one behind it where its start
    lies inside; the greatest base end so far and the least base start to come tell both, so work grows with the spans.
    """

    def free(spans):
        ends = running(F.transform(spans, lambda s: F.when(s["base"], s["end"]).otherwise(F.lit(0).cast("bigint"))), F.greatest)
        starts = F.reverse(running(F.transform(F.reverse(spans), lambda s: F.when(s["base"], F.lit(FAR).cast("bigint") - s["start"]).otherwise(F.lit(0).cast("bigint"))), F.greatest))
        both = F.arrays_zip(ends.alias("before"), starts.alias("after"), spans.alias("s"))
        kept = F.filter(both, lambda x: x["s"]["base"] | ((x["before"] <= x["s"]["start"]) & (F.lit(FAR) - x["after"] >= x["s"]["end"])))
        return F.transform(kept, lambda x: x["s"])

    return F.when(F.exists(found, lambda s: ~s["base"]), let(F.array_sort(found), free)).when(F.size(found) > 0, F.array_sort(found)).otherwise(found)


#: Behind every position in a text.
FAR = 1 << 40


@dataclass
class SpanModel:
    """Prior of each kind, vote probabilities of a kind [labeler][truth][vote + 1], and the classifier's weights by feature and value."""

    priors: dict[int, float] = field(default_factory=dict)
    votes: dict[int, np.ndarray] = field(default_factory=dict)
    bias: float = -9.0
    weights: dict[str, dict[int, float]] = field(default_factory=dict)

    def probability(self, s: Column) -> Column:
        """The classifier's probability of a span, as an expression."""
        z = F.lit(float(self.bias))
        for name, values in self.weights.items():
            feature = s["kind"] * 3 + s[name] + 1 if name in LABELERS else s[name]
            for value, w in values.items():
                z = z + F.when(feature == value, float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


LABELERS = ("format", "gazetteer", "context")
FEATURES = ("kind", *LABELERS, "line", "size")
#: Shares of votes against, none and for that each labeler is taken to give on false and on true spans, and how much this
#: counts beside the spans of a kind: without it one class could swallow the other where only one labeler tells them apart.
BELIEF = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]]) / 6
BELIEF_SHARE = 0.2


def fit(found: DataFrame, spans: str = "spans") -> SpanModel:
    """EM over the counts of vote patterns, then a logistic regression on its soft labels.

    Labelers are judged for each kind by itself. Base spans are true by definition and anchor the EM; for all others the
    votes decide. The regression knows each labeler's vote together with the kind.
    """
    s = found.select(F.explode(spans).alias("s"))
    rows = s.groupBy(*(F.col(f"s.{f}") for f in (*FEATURES, "base"))).count().orderBy(*FEATURES, "base").collect()
    if not rows:
        return SpanModel()
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    n = np.array([r["count"] for r in rows], float)
    sure = np.array([r["base"] for r in rows])
    kind, votes = x[:, 0], x[:, 1:4]
    model = SpanModel(bias=0.0)
    p = np.zeros(len(n))
    for k in np.unique(kind):
        mine = kind == k
        prior, table, p[mine] = _agree(votes[mine], n[mine], sure[mine])
        model.priors[int(k)], model.votes[int(k)] = prior, table
    x[:, 1:4] += 1 + 3 * kind[:, None]
    names = [(f, int(v)) for i, f in enumerate(FEATURES) for v in np.unique(x[:, i])]
    design = np.stack([x[:, FEATURES.index(f)] == v for f, v in names], axis=1).astype(float)
    w, bias = np.zeros(len(names)), 0.0
    share = n / n.sum() * 0.5 + np.array([n[i] / n[kind == kind[i]].sum() for i in range(len(n))]) / len(np.unique(kind)) * 0.5  # rare kinds count too
    for _ in range(3000):
        g = share * (1 / (1 + np.exp(-np.clip(design @ w + bias, -30, 30))) - p)
        w, bias = w - 2.0 * (design.T @ g + 1e-4 * w), bias - 2.0 * g.sum()
    for (f, v), value in zip(names, w):
        model.weights.setdefault(f, {})[v] = round(float(value), 9)
    model.bias = round(float(bias), 9)
    return model


def _agree(votes: np.ndarray, n: np.ndarray, sure: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """EM for the spans of one kind: their prior, the labelers' vote probabilities, and each pattern's probability of being true."""
    total = votes.sum(axis=1) + votes[:, LABELERS.index("context")]  # to begin with, the words in front count double
    p = np.where(sure | (total > 0), 0.9, np.where(total < 0, 0.1, 0.5))
    telling = [i for i in range(votes.shape[1]) if len(np.unique(votes[:, i])) > 1]  # who says the same of all spans says nothing
    at = [[votes[:, labeler] == vote for vote in (-1, 0, 1)] for labeler in range(votes.shape[1])]
    for _ in range(rounds):
        prior = ((n * p).sum() + 1) / (n.sum() + 2)
        table = np.array([[[(n * q)[a].sum() for a in row] for q in (1 - p, p)] for row in at]) + BELIEF * max(1.0, BELIEF_SHARE * n.sum())
        table /= table.sum(axis=2, keepdims=True)
        z = np.log(prior / (1 - prior)) + sum(np.log(table[i, 1, votes[:, i] + 1] / table[i, 0, votes[:, i] + 1]) for i in telling)
        if telling:
            p = np.where(sure, 1 - 1e-6, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return float(prior), table, p


def decided(found: Column, model: SpanModel) -> Column:
    """Base spans and the others that the classifier accepts."""
    return F.filter(found, lambda s: s["base"] | (model.probability(s) >= 0.5))


def count_base(spans: Column, kind: str) -> Column:
    """How many base spans of a kind there are."""
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == KINDS.index(kind)))).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, its candidate spans and the columns to keep; the table that models are fitted on."""
    kept = [c for c in keep if c != doc_id]
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), candidates(F.col(text)).alias("__found"), *kept)
    return found.select("doc_id", without_overlaps(F.col("__found")).alias("spans"), *kept)


#: A text is cut into parts of so many characters, so that a piece is taken out without reading the text from its beginning.
PART = 512


def redacted(value: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one of the first kind. Work grows with text and spans."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def build(parts):
        def piece(a, b):
            first = F.floor(a / PART).cast("int")
            around = F.array_join(F.slice(parts, first + 1, F.floor(F.greatest(b - 1, a) / PART).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(around, (a % PART + 1).cast("int"), (b - a).cast("int"))).otherwise("")

        def rebuild(ends):
            both = F.arrays_zip(F.concat(F.array(F.lit(0).cast("bigint")), F.slice(ends, F.lit(1), F.size(ends) - 1)).alias("before"), spans.alias("s"))
            fresh = F.filter(both, lambda x: x["s"]["start"] >= x["before"])
            cut = F.transform(fresh, lambda x: F.concat(piece(x["before"], x["s"]["start"]), F.element_at(names, x["s"]["kind"] + 1)))
            return F.concat(F.array_join(cut, ""), piece(F.element_at(ends, -1), F.length(value).cast("bigint")))

        return let(running(F.transform(spans, lambda s: s["end"]), F.greatest), rebuild)

    return let(F.regexp_extract_all(value, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), build)


def redact(found: DataFrame, model: SpanModel, *, text: str = "text") -> DataFrame:
    """The rows of ``find`` (with the text kept) without their spans: every decided span replaced in the text. A null text stays null."""
    decided_ = found.withColumn("spans", decided(F.col("spans"), model))
    return decided_.withColumn(text, F.when(F.size("spans") > 0, redacted(F.col(text), F.col("spans"))).otherwise(F.col(text))).drop("spans")
