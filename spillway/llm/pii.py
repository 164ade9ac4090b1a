"""Personal data by weak supervision, in DataFrame functions alone.

Four kinds (email, ip, card, phone) have a base: matches of a pattern that pass a test; base spans always stay. Looser
patterns give further candidates: matches that failed the test (cards: that have 13 to 19 digits), local phone numbers,
social security numbers and long secrets. Five labelers vote on every candidate (1 personal, -1 not, 0 no vote): its form, a gazetteer of domains, prefixes
and ranges, cue words before it, its borders, and its variety of characters. Expectation maximisation estimates, from the
counts of all vote patterns, how reliable each labeler is, and so a probability for each pattern. With these as weights a
naive Bayes classifier is trained on features of the candidates (kind, length, cue, borders, layout), and candidates it
takes for personal data become spans too, where no base span is. A cue word is one labeler and one feature among others.

Positions are running sums, and what overlaps is told by running extremes, both over chunks, so that time hardly grows
faster than the length of a text however many candidates it has.

There are at most 3**5 vote patterns and a fixed number of features, so what reaches the driver is bounded. Everything
else stays in rows: one pass over the texts writes the candidates, and models are applied as expressions of literals.

Defined cases: null text is empty and has no spans; a document is its doc_id and text, repeated rows get the same spans;
the null doc_id is an id like others; extra columns are kept; empty in, empty out. Positions are code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import let, materialise, text_of

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method finds.
FURTHER = ("number", "local_phone", "ssn", "secret")
# A match starts where its run of characters does, or where the last match ended: without that, long runs would be
# scanned from each of their characters. Possessive repeats keep Java from recursing.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# Whole runs of 13 to 19 digits: a run ends where no digit follows, so others hold no match.
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_LOCAL_PHONE = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
_SSN = r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_SECRET = r"(?<![A-Za-z0-9])(?:[A-Fa-f0-9]{32,}+|(?:sk|pk|ghp|gho|xoxb|AKIA)[_-]?[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_TLDS = "com|org|net|edu|gov|io|co|info|biz|de|fr|es|it|uk|eu|us|ca|nl|ch|at|be|pl|se|no|dk|fi|pt|ru|jp|cn|in|br|au|example|invalid|test"
_CUES = r"(?i)(?:e-?mail|mail|contact|write|phone|tel|call|fax|mobile|cell|ip|host|server|address|card|visa|mastercard|credit|account|iban|token|secret|password|passwd|api.?key|key|ssn|social)\W{0,12}$"
_BEFORE = 32
_NEVER = (1 << 31) - 1
LABELERS = 5
#: Rounds of expectation maximisation.
ROUNDS = 25


#: Elements of a chunk of a running sum.
_CHUNK = 256


def _running(values: Column, zero: Column, combine) -> Column:
    """For each value what combine() makes of zero and all values before it; combine is associative, like a sum."""

    def plain(part: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def chunked(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda part: F.aggregate(part, zero, combine))
        each = lambda before: F.flatten(F.transform(chunks, lambda part, i: F.transform(plain(part), lambda x: combine(F.get(before, i), x))))
        return let(plain(totals), each)

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int")), lambda c: F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK)))
    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), chunked)).otherwise(F.array().cast("array<int>")))


def _found(text: Column, pattern: str, kind: str, guard: Column, passes) -> Column:
    """Candidates: kind, start, end, value, whether it passes, and what stands around it, from the pieces between matches."""
    shape = "array<struct<kind:string,s:int,e:int,v:string,ok:boolean,before:string,right:string>>"
    none = F.array().cast(shape)

    def place(pieces: Column, values: Column) -> Column:
        steps = F.transform(values, lambda v, i: F.length(F.get(pieces, i)) + F.length(v))

        def each(starts: Column) -> Column:
            def one(v: Column, i: Column) -> Column:
                s = F.get(starts, i) + F.length(F.get(pieces, i))
                before = F.right(F.concat(F.coalesce(F.get(values, i - 1), F.lit("")), F.get(pieces, i)), F.lit(_BEFORE))
                after = F.get(pieces, i + 1)
                right = F.left(F.when(after != "", after).otherwise(F.coalesce(F.get(values, i + 1), F.lit(""))), F.lit(1))
                return F.struct(F.lit(kind).alias("kind"), s.alias("s"), (s + F.length(v)).alias("e"), v.alias("v"), passes(v).alias("ok"), before.alias("before"), right.alias("right"))

            return F.transform(values, one)

        return let(_running(steps, F.lit(0), lambda a, x: a + x), each)

    both = lambda values: F.when(F.size(values) > 0, let(F.split(text, pattern, -1), lambda p: place(p, values))).otherwise(none)
    return F.when(guard, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), both)).otherwise(none)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """13 to 19 digits whose weighted sum is a multiple of 10."""
    d = F.reverse(_digits(v))

    def total(text: Column) -> Column:
        values = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)).cast("int"))
        doubled = F.transform(values, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x)))
        return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0

    n = F.length(_digits(v))
    return F.when((n >= 13) & (n <= 19), let(d, total)).otherwise(F.lit(False))


def _candidates(text: Column) -> Column:
    digit = text.rlike("[0-9]")
    n_digits = lambda v: F.length(_digits(v))
    always = lambda v: F.lit(True)
    parts = [
        _found(text, _EMAIL, "email", F.contains(text, F.lit("@")), always),
        _found(text, _IP, "ip", digit & text.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
        _found(text, _CARD, "card", digit, _luhn),
        _found(text, _PHONE, "phone", digit & F.contains(text, F.lit("+")), lambda v: (n_digits(v) >= 9) & (n_digits(v) <= 15)),
        _found(text, _LOCAL_PHONE, "local_phone", digit, always),
        _found(text, _SSN, "ssn", digit & F.contains(text, F.lit("-")), always),
        _found(text, _SECRET, "secret", digit, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")),
    ]
    return F.concat(*parts)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def _judged(c: Column) -> Column:
    """A candidate with its votes and features."""
    s, e, v, kind, before, right = c["s"], c["e"], c["v"], c["kind"], c["before"], c["right"]
    left = F.right(before, F.lit(1))
    cue = before.rlike(_CUES)
    base = kind.isin(*KINDS)
    open_left, open_right = left.rlike(r"^[A-Za-z0-9@_/]$"), right.rlike(r"^[A-Za-z0-9@_/]$")
    known = (
        F.when(kind == "email", v.rlike(rf"(?i)\.(?:{_TLDS})$"))
        .when(kind == "ip", ~v.rlike(r"^(?:0|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."))
        .when(kind == "card", v.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"))
        .when(kind == "phone", v.rlike(r"^\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-6]|8[1246]|9[0-58])"))
        .when(kind == "ssn", ~v.rlike("^(?:000|666|9)|-00-|-0000$"))
        .when(kind == "local_phone", v.rlike(r"^\(?[2-9]"))
        .otherwise(F.lit(None).cast("boolean"))
    )
    variety = F.size(F.array_distinct(F.split(_digits(v), "")))
    votes = F.array(
        _vote(c["ok"] & base, ~c["ok"]),
        F.when(known.isNull(), 0).otherwise(_vote(known, ~known)).cast("int"),
        _vote(cue, F.lit(False)),
        _vote(~open_left & ~open_right, open_left | open_right),
        _vote((variety >= 5) | (kind == "email"), (variety <= 2) & (kind != "email")),
    )
    side = lambda x: F.when(x == "", "end").when(x.rlike(r"^\s$"), "space").when(x.rlike("^[A-Za-z0-9]$"), "word").otherwise("mark")
    features = F.array(
        F.concat(F.lit("kind="), kind),
        F.concat(F.lit("length="), F.least(F.length(v) / 4, F.lit(16)).cast("int").cast("string")),
        F.concat(F.lit("cue="), cue.cast("string")),
        F.concat(F.lit("left="), side(left)),
        F.concat(F.lit("right="), side(right)),
        F.concat(F.lit("form="), kind, F.lit(":"), c["ok"].cast("string")),
        F.concat(F.lit("separated="), v.rlike(r"[\x20().-]").cast("string")),
    )
    return F.struct(kind.alias("kind"), s.alias("s"), e.alias("e"), c["ok"].alias("ok"), (base & c["ok"]).alias("base"), votes.alias("votes"), features.alias("features"))


def fit_labelers(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """votes and the probability p that candidates with them are personal, for rows (votes, n); one row per pattern.

    The rounds run inside one expression over the array of all patterns, of which there are at most 3**LABELERS.
    """
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("rows"))
    labelers = F.sequence(F.lit(0), F.lit(LABELERS - 1))
    smooth = 1.0
    # Of each labeler: how often it votes 1 and -1 on personal candidates (yes), and on others (no).
    start = F.struct(
        F.lit(0.5).alias("prior"),
        F.transform(labelers, lambda _: F.struct(F.lit(0.7).alias("yes_up"), F.lit(0.1).alias("yes_down"), F.lit(0.2).alias("no_up"), F.lit(0.5).alias("no_down"))).alias("rates"),
    )

    def likelihood(state: Column, votes: Column, up: str, down: str) -> Column:
        def term(a: Column, i: Column) -> Column:
            r, v = F.get(state["rates"], i), F.get(votes, i)
            return a * F.when(v > 0, r[up]).when(v < 0, r[down]).otherwise(1.0 - r[up] - r[down])

        return F.aggregate(labelers, F.lit(1.0), term)

    def posterior(state: Column, votes: Column) -> Column:
        yes = state["prior"] * likelihood(state, votes, "yes_up", "yes_down")
        no = (1.0 - state["prior"]) * likelihood(state, votes, "no_up", "no_down")
        return yes / (yes + no + F.lit(1e-300))

    def step(rows: Column):
        def run(state: Column, _: Column) -> Column:
            weighed = F.transform(rows, lambda r: F.struct(r["votes"].alias("votes"), (r["n"] * posterior(state, r["votes"])).alias("y"), r["n"].alias("n")))

            def maximise(w: Column) -> Column:
                total = lambda f: F.aggregate(w, F.lit(0.0), lambda a, r: a + f(r))
                y, n = total(lambda r: r["y"]), total(lambda r: r["n"])

                def rates(i: Column) -> Column:
                    share = lambda part, sign, of: (total(lambda r: F.when(F.get(r["votes"], i) == sign, part(r)).otherwise(0.0)) + smooth) / (of + 3 * smooth)
                    own, other = lambda r: r["y"], lambda r: r["n"] - r["y"]
                    return F.struct(share(own, 1, y).alias("yes_up"), share(own, -1, y).alias("yes_down"), share(other, 1, n - y).alias("no_up"), share(other, -1, n - y).alias("no_down"))

                return F.struct(((y + smooth) / (n + 2 * smooth)).alias("prior"), F.transform(labelers, rates).alias("rates"))

            return let(weighed, maximise)

        return run

    fitted = one.select("rows", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step(F.col("rows"))).alias("state"))
    return fitted.select(F.explode(F.transform("rows", lambda r: F.struct(r["votes"].alias("votes"), posterior(F.col("state"), r["votes"]).alias("p")))).alias("x")).select("x.votes", "x.p")


def _key() -> list[Column]:
    return [F.col("doc_id").cast("string").alias("_spw_id"), F.xxhash64(text_of(), F.lit(11)).alias("_spw_text")]


def find_spans(docs: DataFrame) -> DataFrame:
    """_spw_id, _spw_text (what tells a document), base and spans (arrays of kind, s, e) of every row of docs (doc_id, text)."""
    text = text_of()
    # Candidates are few: their text is cut out here, so that no text goes on.
    judged = let(text, lambda t: F.transform(_candidates(t), _judged))
    rows = materialise(docs.select(*_key(), F.when(text.rlike("[0-9@]"), judged).alias("found")).select("_spw_id", "_spw_text", "found"), "candidates")
    each = rows.select(F.explode("found").alias("c")).select("c.*")
    probability = fit_labelers(each.groupBy("votes").agg(F.count("*").alias("n")))
    # At most 3**LABELERS rows.
    weighed = each.join(F.broadcast(probability), "votes")
    counts = weighed.select(F.explode("features").alias("feature"), "p").groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    # A row per value of a feature: fewer than a hundred.
    learned = {r["feature"]: (r["yes"], r["no"]) for r in counts.collect()}
    yes, no = (sum(x[k] for f, x in learned.items() if f.startswith("kind=")) for k in (0, 1))
    bias = math.log((yes + 1) / (no + 1))
    table = [x for f, (y, n) in sorted(learned.items()) for x in (F.lit(f), F.lit(math.log((y + 1) / (yes + 2)) - math.log((n + 1) / (no + 2))))]
    weights = F.create_map(*table) if table else F.create_map(F.lit(""), F.lit(0.0))
    score = lambda c: F.aggregate(c["features"], F.lit(bias), lambda a, f: a + F.coalesce(F.element_at(weights, f), F.lit(0.0)))
    found = F.coalesce(F.col("found"), F.array().cast(rows.schema["found"].dataType))
    bare = lambda a: F.transform(a, lambda c: F.struct(F.when(c["base"] | ~c["kind"].isin("card", "ip", "phone"), c["kind"]).otherwise("number").alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    base = F.filter(found, lambda c: c["base"])

    def beside(by_start: Column) -> Column:
        """Further spans: taken for personal, and apart from base spans, of which none that begins before ends within, nor begins within."""
        ends = _running(F.transform(by_start, lambda c: F.when(c["base"], c["e"]).otherwise(-1)), F.lit(-1), lambda a, x: F.greatest(a, x))
        starts = F.reverse(_running(F.reverse(F.transform(by_start, lambda c: F.when(c["base"], c["s"]).otherwise(_NEVER))), F.lit(_NEVER), lambda a, x: F.least(a, x)))
        apart = lambda x: F.filter(by_start, lambda c, i: ~c["base"] & (score(c) > 0) & (F.get(x["ends"], i) <= c["s"]) & (F.get(x["starts"], i) >= c["e"]))
        return let(F.struct(ends.alias("ends"), starts.alias("starts")), apart)

    by_start = F.array_sort(F.transform(found, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"), c["base"].alias("base"), c["features"].alias("features"))))
    rank = F.create_map(*[x for i, k in enumerate((*KINDS, *FURTHER)) for x in (F.lit(k), F.lit(i))])
    ranked = lambda a: F.array_sort(F.transform(a, lambda c: F.struct(F.element_at(rank, c["kind"]).alias("r"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
    once = lambda a: let(a, lambda x: F.filter(x, lambda c, i: (i == 0) | (c != F.get(x, i - 1))))
    ordered = lambda a: F.transform(once(ranked(a)), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    return rows.select("_spw_id", "_spw_text", ordered(bare(base)).alias("base"), ordered(F.concat(bare(base), bare(let(by_start, beside)))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["s"].cast("string"), c["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone of base spans, their list's sha256, and all spans listed."""
    found = find_spans(docs)
    of = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("bigint")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    kind = docs.schema["doc_id"].dataType
    return found.select(F.col("_spw_id").cast(kind).alias("doc_id"), *counts, F.sha2(F.encode(listed(F.col("base")), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """docs, with each span replaced by its kind in angle brackets; where spans overlap, the one that starts first is."""
    spans = find_spans(docs).groupBy("_spw_id", "_spw_text").agg(F.first("spans").alias("_spw_spans")).where(F.size("_spw_spans") > 0)
    keys = dict(zip(("k_id", "k_text"), _key(), strict=True))
    spans = spans.withColumnsRenamed({"_spw_id": "_spw_k_id", "_spw_text": "_spw_k_text"})
    joined = docs.withColumns({f"_spw_{n}_own": c for n, c in keys.items()}).join(spans, F.col("_spw_k_id_own").eqNullSafe(F.col("_spw_k_id")) & (F.col("_spw_k_text_own") == F.col("_spw_k_text")), "left")
    text = F.col("text")

    def put(by_start: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, c: Column) -> Column:
            piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, c["s"] - acc["at"]), F.lit("<"), F.upper(c["kind"]), F.lit(">"))
            return F.when(c["s"] >= acc["at"], F.struct(c["e"].alias("at"), piece.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], c["e"]).alias("at"), acc["out"].alias("out")))

        return F.aggregate(by_start, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))

    by_start = F.array_sort(F.transform("_spw_spans", lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("n"), c["e"].alias("e"), c["kind"].alias("kind"))))
    masked = F.when(F.col("_spw_spans").isNull(), text).otherwise(let(by_start, put))
    return joined.withColumn("_spw_masked", masked).select(*[F.col("_spw_masked").alias("text") if c == "text" else F.col(c) for c in docs.columns])
