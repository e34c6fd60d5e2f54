"""PII (op5): candidate gradient boosting, in DataFrame functions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers; their spans always stay. High-recall generators
propose further, overlapping spans (obfuscated addresses, numbers with other separators, lengths or without a prefix). Every candidate
gets small integer features of its format and context. Boosted trees of depth two tell whether it is personal data.

The trees learn from items that are planted in snippets of the corpus (`planted`): personal data in plain and obfuscated
formats, and hard negatives that look alike (versions, dates, times, order numbers, ranges, prices, ISBNs); base rules have no part in
the labels. The snippets are of at most max_contexts documents, chosen by a hash; half of the planted texts fit the trees, a
quarter calibrates: a logistic curve for each kind, and the lowest calibrated probability at which precision is least_precision;
the last quarter is only measured (`Model.held_out`). The model is one SQL expression; of the candidates that pass and touch no base span,
overlapping ones give way to the earliest and longest, and the rest are added.

Positions: a regular expression's matches and the pieces between them are taken by the same matcher, and the running
sum of their lengths in code points gives starts and ends. Patterns begin only where a run of their characters begins (or where the
last match ended) and are possessive, where that changes no match, so the time on a text is linear but for the number of its matches.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, read_table

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
GENERATORS = {
    "email": _LOCAL + r" ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]++(?:(?:\.| \. | ?\[dot\] ?| ?\(dot\) ?)[A-Za-z0-9-]++)++",
    "ip": r"[0-9]{1,3}+(?:(?:\[\.\]|[.,:_])[0-9]{1,3}+){3}",
    "card": r"[0-9](?:[ ./_-]?[0-9]){12,18}",
    "phone": r"[+(]?[0-9](?:[ ()./-]{0,2}[0-9]){7,14}",
}
#: Cheap tests that a text must pass before the patterns of a kind run on it.
GUARD = {"email": r"@|\[at\]|\(at\)", "ip": r"[0-9](?:\[\.\]|[.,:_])[0-9]", "card": r"[0-9](?:[ ./_-]?[0-9]){12}", "phone": r"[0-9](?:[ ()./-]{0,2}[0-9]){6}|\+[0-9]"}
FEATURES = ["kind", "digits", "marks", "plus", "bracket", "before", "after", "word", "valid", "dots", "first", "last", "spaces", "groups"]
_SPAN = "array<struct<s:int,e:int,m:string,b:string,a:string>>"
_WORDS = [r"tel|phone|call|fax|mobil", r"card|visa|pay|credit", r"mail|contact", r"\bip\b|host|server|addr", r"order|ref|invoice|version|isbn|date|total|\bno\b"]


def _let(value: Column, of) -> Column:
    """An expression of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def find(text: Column, pattern: str, chunk: int = 128) -> Column:
    """All matches of a pattern, leftmost and not overlapping: array of (s, e, m, b, a); b and a are up to 16 code points before and one after, as far as no other match reaches.

    Places are summed up in chunks of matches and then over chunks, for an array that grows in an aggregate is copied at each step.
    """
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(between, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    both = F.zip_with(pairs, F.slice(between, 2, 1 << 30), lambda x, n: F.struct(x["p"].alias("p"), x["m"].alias("m"), F.substring(n, 1, 1).alias("a")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.coalesce(F.length(x["m"]), F.lit(0))
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), F.right(x["p"], F.lit(16)).alias("b"), x["a"].alias("a")))
        return F.struct(e.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    def placed(parts: Column) -> Column:
        before = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        moved = lambda y, o: F.struct((y["s"] + o).alias("s"), (y["e"] + o).alias("e"), y["m"].alias("m"), y["b"].alias("b"), y["a"].alias("a"))
        return F.flatten(F.zip_with(parts, before, lambda x, o: F.transform(x["out"], lambda y: moved(y, o))))

    in_chunks = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / chunk).cast("int")), lambda c: F.aggregate(F.slice(all_, c * chunk + 1, F.lit(chunk)), start, step))
    return _let(_let(both, in_chunks), placed)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, [0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _only(m: Column, keep: str) -> Column:
    return F.regexp_replace(m, keep, "")


def valid(kind: str, m: Column) -> Column:
    """The base rule's test of a match."""
    digits = _only(m, "[^0-9]")
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _class(c: Column) -> Column:
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).when(c.rlike(r"^\s$"), 0).when(c.rlike("^[A-Za-z0-9]$"), 1).when(c.rlike(r"^[.,;:!?)]$"), 2).otherwise(3)


def _sound(k: int, m: Column, digits: Column) -> Column:
    """Whether the normalised form of a candidate is one: a known kind of top-level domain, octets, the card checksum, few enough digits."""
    if KINDS[k] == "email":
        return F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1).rlike("^(?:com|org|net|edu|gov|info|biz|io|[a-z]{2})$")
    if KINDS[k] == "ip":
        parts = F.transform(F.split(m, "[^0-9]+"), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if KINDS[k] == "card":
        return luhn(digits)
    return F.length(digits).between(8, 15)


def _vector(kind: int, x: Column) -> Column:
    m, word = x["m"], F.lit(0)
    near = F.lower(x["b"])
    for i, pattern in reversed(list(enumerate(_WORDS))):
        word = F.when(near.rlike(pattern), i + 1).otherwise(word)
    count = lambda chars: F.length(_only(m, f"[^{chars}]"))
    group = lambda pattern: F.least(F.length(F.regexp_extract(m, pattern, 1)), F.lit(8))
    return F.array(
        F.lit(kind), F.least(count("0-9"), F.lit(20)), F.least(count(r" ()./,:_-"), F.lit(8)), m.startswith("+").cast("int"), m.rlike(r"[(\[]").cast("int"),
        _class(F.right(x["b"], F.lit(1))), _class(x["a"]), word, _sound(kind, m, _only(m, "[^0-9]")).cast("int"), F.least(count("."), F.lit(4)),
        group("^[^0-9]*([0-9]*)"), group("([0-9]*)[^0-9]*$"), F.least(count(" "), F.lit(4)), F.least(F.regexp_count(m, F.lit("[0-9]+")), F.lit(8)),
    )


def _extract(docs: DataFrame, *also) -> DataFrame:
    """doc_id, base (k, s, e), candidates (k, s, e, f) of each row of (doc_id, text), and the columns also."""
    text = F.col("text")
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    base, cand = [], []

    def of_kind(k: int, kind: str) -> None:
        guard, place = text.rlike(GUARD[kind]), lambda x: (F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"))
        good = F.filter(find(text, BASE[kind]), lambda x: valid(kind, x["m"]))
        base.append(F.when(guard, F.transform(good, lambda x: F.struct(*place(x)))).otherwise(none))
        vectors = F.transform(find(text, GENERATORS[kind]), lambda x: F.struct(*place(x), _vector(k, x).alias("f")))
        cand.append(F.when(guard, vectors).otherwise(F.array().cast("array<struct<k:int,s:int,e:int,f:array<int>>>")))

    for k, kind in enumerate(KINDS):
        of_kind(k, kind)
    return docs.select("doc_id", *also, F.concat(*base).alias("base"), F.concat(*cand).alias("cand"))


# training ---------------------------------------------------------------------------------------------------------------


def _checked(digits: str, good: bool, rnd: random.Random) -> str:
    """The digits and a last one that does, or does not, meet the card checksum."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    last = -total % 10
    return digits + str(last if good else (last + rnd.randint(1, 9)) % 10)


def _item(kind: str, good: bool, rnd: random.Random) -> str:
    """An invented item of personal data in one of its formats, or something that looks like one."""
    word = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(3, 9)))
    num = lambda n: str(rnd.randint(1, 9)) + "".join(rnd.choice("0123456789") for _ in range(n - 1))
    cut = lambda s, sizes, sep: sep.join(s[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))
    if kind == "email":
        at, dot = rnd.choice([("@", "."), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" @ ", ".")])
        if good:
            name = rnd.choice([word(), f"{word()}.{word()}", f"{word()}{num(2)}"])
            return name + at + word() + rnd.choice(["", dot + word()]) + dot + rnd.choice(["com", "org", "net", "de", "fr", "es", "io", "info"])
        return rnd.choice([f"{num(1)} @ {num(2)}.{num(2)}", f"{word()} (at) {num(2)}.{num(2)}", f"{word()} (at) {word()}. {word().title()}", f"{word()} [at] {word()}. {word().title()}", f"{num(3)} @ {num(1)}.{num(3)}"])
    if kind == "ip":
        octets = [str(rnd.randint(0, 255)) for _ in range(4)]
        if good:
            return rnd.choice([".", "[.]", "[.]", "_", ":"]).join(octets)
        times = f"{rnd.randint(10, 23)}:{num(2)}:{num(2)}:{num(2)}"
        return rnd.choice([times, f"{num(1)},{num(3)},{num(3)},{num(3)}", ",".join(num(1) for _ in range(4)), ":".join(num(1) for _ in range(4)), f"{num(1)}.{num(1)}_{num(2)}.{num(3)}"])
    if kind == "card":
        n = rnd.choice([13, 15, 15, 16, 16, 16, 19]) if good else rnd.choice([13, 14, 15, 16, 16])
        digits = _checked(num(n - 1), good, rnd)
        sizes = {13: [4, 3, 3, 3], 14: [4, 6, 4], 15: [4, 6, 5], 16: [4, 4, 4, 4], 19: [4, 4, 4, 4, 3]}[n]
        if good:
            return cut(digits, sizes, rnd.choice([" ", "-", ".", "/", "_", ""]))
        stamp = f"20{num(2)}{rnd.choice(['/', '-', '.', ''])}0{num(1)}{rnd.choice(['/', '-', '.', ''])}1{rnd.randint(0, 9)} {rnd.randint(10, 23)}{num(4)}"
        return rnd.choice([cut(digits, sizes, rnd.choice([" ", "-", ".", "/", ""])), cut(digits, sizes, ""), stamp, f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}"])
    if good:
        a, b, c = num(3), num(3), num(4)
        return rnd.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1 {a} {b} {c}", f"0{num(2)} {num(4)} {num(4)}", f"+{num(2)} {a} {b} {c}", f"+1 ({a}) {b}-{c}"])
    date = f"20{num(2)}-0{num(1)}-1{rnd.randint(0, 9)}"
    return rnd.choice([f"{date} {rnd.randint(10, 23)}", f"{num(4)}-{num(4)}", f"{num(1)} {num(3)} {num(3)} {num(3)}", num(rnd.randint(8, 14)), f"1{rnd.randint(0, 9)}/0{num(1)}/20{num(2)} {rnd.randint(10, 23)}", f"{num(3)}.{num(6)}", f"{num(5)}/{num(4)}"])


#: What stands before an item: its own words, or those of other numbers.
_LEADS = {"email": ["e-mail", "contact", "mail to"], "ip": ["ip", "host", "server at", "address"], "card": ["card", "visa", "paid with", "credit card"], "phone": ["tel", "phone", "call", "fax", "mobile"]}
_OTHER = ["order", "ref", "invoice", "version", "isbn", "date", "at", "no.", "total"]


def planted(contexts: list[str], copies: int = 4, seed: int = 5) -> list[tuple]:
    """(doc_id, part, text, k, s, e, good): items in the middle of snippets; s and e in code points; part 0, 1 fit, 2 calibrates, 3 is held out."""
    rnd, out = random.Random(seed), []
    for context in contexts or [""]:
        for _ in range(copies):
            k, good = rnd.randrange(len(KINDS)), rnd.random() < 0.5
            item = _item(KINDS[k], good, rnd)
            own, drawn = rnd.choice(_LEADS[KINDS[k]]), rnd.random()
            lead = own if drawn < (0.6 if good else 0.1) else "" if drawn < 0.8 else rnd.choice(_OTHER if not good else ["", "and", "or"])
            middle = rnd.randint(0, len(context))
            while 0 < middle < len(context) and not context[middle].isspace():
                middle += 1
            left = context[:middle] + " " + lead + rnd.choice([" ", ": ", " "])
            text = left + item + rnd.choice([" ", ". ", ", ", "\n"]) + context[middle:].lstrip()
            out.append((len(out), len(out) % 4, text, k, len(left), len(left) + len(item), good))
    return out


def boost(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, rounds: int = 30, rate: float = 0.3, ridge: float = 1.0) -> tuple[list[tuple], np.ndarray]:
    """Trees (feature, cut, (feature, cut, low, high) left, the same right) on counted rows, and the rows' probabilities."""
    total, score, trees = pos + neg, np.zeros(len(x)), []

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        found = (-1.0, 0, -1, 0.0, 0.0)
        gt, ht = g[rows].sum(), h[rows].sum()
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1] if rows.any() else ():
                left = rows & (x[:, f] <= cut)
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                if gain > found[0] + 1e-12:
                    found = (gain, f, int(cut), rate * gl / (hl + ridge), rate * (gt - gl) / (ht - hl + ridge))
        if found[2] < 0:
            return 0, -1, rate * gt / (ht + ridge), rate * gt / (ht + ridge)
        return found[1:]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = pos - total * p, total * p * (1 - p)
        f, cut, *_ = best(np.ones(len(x), bool), g, h)
        low = x[:, f] <= cut
        sides = [best(side, g, h) for side in (low, ~low)]
        trees.append((f, cut, *sides))
        for side, (f2, c2, a, b) in zip((low, ~low), sides):
            score += np.where(side, np.where(x[:, f2] <= c2, a, b), 0.0)
    return trees, 1 / (1 + np.exp(-score))


@dataclass(frozen=True)
class Model:
    """Trees over FEATURES; for each kind a calibration (slope, bias) of their sum, and the least calibrated probability."""

    trees: list[tuple]
    curves: list[tuple[float, float]]
    limits: list[float]
    held_out: dict[str, tuple[float, float, int]]  # recall, precision and good items by kind

    def sql(self) -> str:
        """Whether the candidate c passes."""
        side = lambda t: f"IF(c.f[{t[0]}] <= {t[1]}, {float(t[2])!r}D, {float(t[3])!r}D)"
        total = " + ".join(["0D", *(f"IF(c.f[{f}] <= {cut}, {side(a)}, {side(b)})" for f, cut, a, b in self.trees)])
        least = [(math.log(t / (1 - t)) - bias) / slope if 0 < t < 1 else 1e300 for (slope, bias), t in zip(self.curves, self.limits)]
        return f"({total}) >= array({', '.join(f'{x!r}D' for x in least)})[c.k]"


def _scores(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    score = np.zeros(len(x))
    for f, cut, *sides in trees:
        low, high = (np.where(x[:, f2] <= c2, a, b) for f2, c2, a, b in sides)
        score += np.where(x[:, f] <= cut, low, high)
    return score


def calibrate(score: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and bias of a logistic curve through scores; the slope is positive."""
    w, design = np.array([1.0, 0.0]), np.stack([score, np.ones_like(score)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), design.T @ (p - y) + ridge * (w - [1.0, 0.0]))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def train(docs: DataFrame, text_col: str = "text", least_precision: float = 0.97, least_score: float = 0.5, max_contexts: int = 1500) -> Model:
    """Fit, calibrate and measure on planted texts; snippets are the first 240 code points of at most max_contexts texts."""
    spark = docs.sparkSession
    snippet = docs.select(F.substring(F.col(text_col).cast("string"), 1, 240).alias("t")).where("t is not null")
    contexts = [r.t for r in hashed_sample(snippet, "t", max_contexts).collect()]
    rows = spark.createDataFrame(planted(contexts), "doc_id long, part int, text string, k int, s int, e int, good boolean")
    found = _extract(rows, "part", F.struct("k", "s", "e", "good").alias("item")).selectExpr("part", "item", "explode(cand) AS c").where("c.s < item.e and item.s < c.e")
    # a candidate is right if it is the planted item but for a tenth; one of another kind is wrong
    right = F.expr("item.good and c.k = item.k and 10 * (least(c.e, item.e) - greatest(c.s, item.s)) >= 9 * (greatest(c.e, item.e) - least(c.s, item.s))")
    table = found.select(F.col("c.f").alias("f"), "part", right.alias("y")).groupBy("f", "part").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((~F.col("y")).cast("long")).alias("neg")).collect()
    items = {(r.part, r.k): r.n for r in rows.where("good").groupBy("part", "k").agg(F.count("*").alias("n")).collect()}
    table.sort(key=lambda r: (r.f, r.part))
    x, part = np.array([r.f for r in table]).reshape(-1, len(FEATURES)), np.array([r.part for r in table])
    pos, neg = np.array([r.pos for r in table], float), np.array([r.neg for r in table], float)
    fit = part < 2
    trees, _ = boost(x[fit], pos[fit], neg[fit])
    score = _scores(trees, x)
    curves, limits, held = [], [], {}
    for k, kind in enumerate(KINDS):
        own = (part == 2) & (x[:, 0] == k)
        many = np.concatenate([pos[own], neg[own]]).astype(int)
        curve = calibrate(np.repeat(np.tile(score[own], 2), many), np.repeat(np.repeat([1.0, 0.0], own.sum()), many))
        p = 1 / (1 + np.exp(-np.clip(curve[0] * score + curve[1], -30, 30)))
        limit = 1.0
        for t in sorted(set(p[own][p[own] >= least_score].tolist())):
            at = own & (p >= t)
            if pos[at].sum() >= least_precision * (pos[at].sum() + neg[at].sum()):
                limit = t - 1e-9
                break
        at = (part == 3) & (x[:, 0] == k) & (p >= limit)
        held[kind] = float(pos[at].sum() / max(items.get((3, k), 0), 1)), float(pos[at].sum() / max((pos[at] + neg[at]).sum(), 1)), items.get((3, k), 0)
        curves.append(curve)
        limits.append(limit)
    return Model(trees, curves, limits, held)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, base and extra (arrays of k, s, e: kind, start, end in code points, end exclusive) of each input row.

    Null text is empty and has no spans. Repeated rows get equal base spans and equal extras. Whole texts are searched, in one pass without a
    shuffle. Without a model one is trained on snippets of these texts; an empty table trains on bare items. Other columns are ignored.
    """
    model = model or train(docs, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen = f"filter(cand, c -> NOT exists(base, b -> b.s < c.e AND c.s < b.e) AND {model.sql()})"
    found = _extract(rows).selectExpr("doc_id", "base", f"array_sort(transform({chosen}, c -> named_struct('s', c.s, 'l', c.s - c.e, 'k', c.k, 'e', c.e))) AS c")
    # in order of start, longest first, what overlaps none before it
    apart = "aggregate(c, named_struct('at', 0, 'out', cast(array() AS array<struct<k:int,s:int,e:int>>)), (a, x) -> IF(x.s >= a.at, named_struct('at', x.e, 'out', concat(a.out, array(named_struct('k', x.k, 's', x.s, 'e', x.e)))), a), a -> a.out)"
    return found.selectExpr("doc_id", "base", f"{apart} AS extra")


def redact(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id and text with each found span replaced by its kind in brackets; overlapping spans are replaced as one. Ids must be unique."""
    merged = F.aggregate(
        F.array_sort(F.transform(F.concat("base", "extra"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.when(x["e"] <= acc["at"], acc).when(x["s"] < acc["at"], F.struct(acc["out"].alias("out"), x["e"].alias("at"))).otherwise(
            F.struct(F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), F.lit("]")).alias("out"), x["e"].alias("at"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(spans, "doc_id").select("doc_id", merged.alias("text"))


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, b -> b.k = {k})) AS BIGINT)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "extra")).alias("spans"))
