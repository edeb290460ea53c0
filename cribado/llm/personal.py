"""Personal data: fixed patterns, and a span classifier trained by weak supervision.

Base spans come from fixed patterns and always stay. Wider patterns yield further candidates, for instance a card
number right behind a telephone number, which the fixed patterns take for one, or keys and passwords, which no base
pattern covers. On each candidate, base spans included, labelers vote for or against or abstain: regex labelers (the
base pattern, the form as a whole), gazetteer labelers (top-level domains, calling codes, card issuers and checksums,
prefixes of keys) and context labelers (the words before it, what touches it on either side). Expectation
maximisation over the counted vote patterns of all documents estimates how reliable each labeler is. The
posteriors train a logistic span classifier, which sees the votes, the appearance of the span and the last word before
it, and decides on the candidates that touch no base span.

Only built-in functions see the documents. What reaches the driver is one count per (kind, votes, appearance, word
class): BOUND rows at most, by construction. The trained weights go back as literals of an expression.

Patterns are written so that the engine neither recurses nor goes over a run of characters again: possessive, and
starting only where a run starts or the last match ended. Places and overlaps are running values over the matches in
order, so a text with very many matches takes little more than its share of time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cribado.functions.plan import with_column_once
from cribado.session import materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method adds; they are no personal data as such and are reported by themselves.
SECRET = len(KINDS)
ALL_KINDS = (*KINDS, "secret")
#: Characters before and after a candidate that context labelers see.
CONTEXT = 40
ROUNDS, STEPS, RATE = 50, 1500, 0.5
LABELERS = ("pattern", "form", "gazetteer", "context", "edge")
SHAPES, WORDS = 8, 7
#: (kind, votes, shape, word class) that there can be.
BOUND = len(ALL_KINDS) * 3 ** len(LABELERS) * SHAPES * WORDS

_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SHORT_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_AT, _DOT = r"(?:\[at\]|\(at\))", r"(?:\.|\[dot\]|\(dot\))"

#: Base patterns, in the fixed order of kinds.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns. The local part of a spelled-out address has 64 characters at most, as mail allows no more.
WIDER = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+ ?{_AT} ?[A-Za-z0-9-]++(?: ?{_DOT} ?[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9]){_SHORT_OCTET}(?:\.{_SHORT_OCTET}){{3}}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{12,19}+|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4})(?![0-9])",
    "phone": r"(?<![0-9+(])(?:\+[0-9]{1,3}[\x20.-]?)?+\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_+/-]{0,40}[0-9])(?=[0-9_+/-]{0,40}[A-Za-z])[A-Za-z0-9_/+-]{16,}+={0,2}",
}
#: What every match of a pattern holds: texts without it need no search. Each guard follows from its own pattern alone.
BASE_GUARD = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WIDER_GUARD = {
    "email": r"[\[(]at[\])]",
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9]{4}",
    "phone": r"[0-9]{3}[\x20.-]?[0-9]{3}",
    "secret": r"[A-Za-z0-9_/+-]{16}",
}
#: Gazetteers: generic and country domains, calling codes, first digits of card issuers, prefixes of keys.
DOMAINS = (
    "com org net edu gov mil int info biz name pro museum coop aero jobs mobi travel tel cat post asia "
    "io dev app web site online shop store blog cloud tech xyz club live news email agency digital media group world space "
    "ac ad ae af ag ai al am ao ar at au az ba bb bd be bf bg bh bi bj bn bo br bs bt bw by bz ca cd cf cg ch ci ck cl cm cn co cr cu cv cy cz "
    "de dj dk dm do dz ec ee eg es et eu fi fj fm fo fr ga gb gd ge gg gh gi gl gm gn gp gq gr gt gy hk hn hr ht hu id ie il im in iq ir is it "
    "je jm jo jp ke kg kh km kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mk ml mm mn mo mq mr ms mt mu mv mw mx my mz na nc ne "
    "ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st sv sy sz "
    "tc td tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
).split()
CALLING_CODES = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "21[12368] 22[0-9] 23[0-9] 24[0-9] 25[0-8] 26[0-9] 29[0178] 35[0-9] 37[0-9] 38[0-9] 42[013] 50[0-9] 59[0-9] 67[0-9] 68[0-9] 69[0-2] "
    "85[0235-6] 88[06] 96[0-8] 97[0-7] 99[2-8]"
).split()
ISSUERS = r"^(?:4|5[0-8]|2[2-7]|3[0-9]|60|62|63|64|65|67|81)"
KEY_PREFIXES = r"^(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|sk-|pk_|rk_|sk_|xox[abprs]-|eyJ|ya29|SG|npm_|hf_)"
#: Words that speak for a kind, and words that speak against all.
FOR = {
    "email": "mail|e-mail|email|emails|mailto|correo|courriel|contact|contacto|kontakt|write|reach|to|from|cc",
    "ip": "ip|ipv4|host|server|address|addr|adresse|dirección|gateway|subnet|dns|client|peer|from|ping|servidor",
    "card": "card|credit|debit|visa|mastercard|amex|discover|karte|kreditkarte|carte|tarjeta|pan|cc",
    "phone": "tel|telf|phone|call|fax|mobile|mobil|cell|whatsapp|telefon|telefonnummer|téléphone|teléfono|móvil|celular|appelez|llame|ring",
    "secret": "token|key|secret|password|passwd|pwd|pass|bearer|apikey|api_key|auth|credential|credentials|clave|contraseña|passwort|jeton",
}
AGAINST = "version|release|isbn|issn|order|invoice|ticket|serial|doi|part|item|model|sku|page|figure|commit|sha|md5|checksum|hash|uuid|ref"
#: Classes of the last word before a candidate: none, each kind's words, words against.
NO_WORD, WORD_AGAINST = 0, WORDS - 1


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def base_valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    size = F.length(digits)
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": lambda: size.between(12, 19) & _luhn(F.when(size.between(12, 19), digits).otherwise(F.lit("1"))),
        "phone": lambda: size.between(9, 15),
    }[kind]()


def _once(value: Column, use) -> Column:
    """`use(value)` with the value computed a single time."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(items: Column, state: str, first: Column, out: str, step) -> Column:
    """`(state, out)`: `step(state, item)` gives the next state and a result of type `out` for each item in turn.

    Appending copies what is there, so the items go in blocks of the root of their number, and the blocks' results are
    put together at the end. Only single results are cast, never what has been gathered.
    """

    def held(state_: Column, results: Column) -> Column:
        return F.struct(state_.cast(state).alias("state"), results.alias("out"))

    def block(start: Column, part: Column) -> Column:
        def add(so_far: Column, item: Column) -> Column:
            after, result = step(so_far["state"], item)
            return held(after, F.array_append(so_far["out"], result.cast(out)))

        return F.aggregate(part, held(start, F.array().cast(f"array<{out}>")), add)

    def blocks(items: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(items))).cast("int")
        starts = F.sequence(F.lit(1), F.size(items), size)

        def add(so_far: Column, start: Column) -> Column:
            done = block(so_far["state"], F.slice(items, start, size))
            return _once(done, lambda d: held(d["state"], F.array_append(so_far["out"], d["out"])))

        empty = held(first, F.array().cast(f"array<array<{out}>>"))
        return F.aggregate(starts, empty, add, lambda so_far: held(so_far["state"], F.flatten(so_far["out"])))

    nothing = held(first, F.array().cast(f"array<{out}>"))
    return _once(items, lambda items: F.when(F.size(items) > 0, blocks(items)).otherwise(nothing))


_MATCH = "struct<start:int,stop:int,value:string,before:string,after:string>"


def located(text: Column, pattern: str, guard: str) -> Column:
    """All matches with their places in code points, and what stands before and after each: a running sum of lengths."""
    shown = F.when(text.rlike(guard), text).otherwise(F.lit(""))

    def matches(shown: Column) -> Column:
        gaps = F.split(shown, pattern, -1)
        values = F.regexp_extract_all(shown, F.lit(pattern), F.lit(0))
        return _once(gaps, lambda gaps: _once(values, lambda values: placed(gaps, values)))

    def placed(gaps: Column, values: Column) -> Column:
        found = F.transform(
            values,
            lambda v, i: F.struct(
                F.length(F.get(gaps, i)).alias("gap"),
                F.length(v).alias("long"),
                v.alias("value"),
                F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"),
                F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
            ),
        )

        def place(at: Column, m: Column) -> tuple[Column, Column]:
            start = at + m["gap"]
            stop = start + m["long"]
            return stop, F.struct(start, stop, m["value"], m["before"], m["after"]).cast(_MATCH)

        return scan(found, "int", F.lit(0), _MATCH, place)["out"]

    return F.when(shown.rlike(pattern), _once(shown, matches)).otherwise(F.array().cast(f"array<{_MATCH}>"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _words_before(words: str) -> str:
    return rf"(?:^|[^\p{{L}}_])(?:{words})[^\p{{L}}]*$"


def _votes(kind: str, found: Column) -> list[Column]:
    value, before, digits = found["value"], F.lower(found["before"]), _digits(found["value"])
    size = F.length(digits)
    luhn = _luhn(F.when(size > 0, digits).otherwise(F.lit("1")))
    first = rf"^\+(?:{'|'.join(CALLING_CODES)})"
    domain = F.lower(value).rlike(rf"(?:\.|\[dot\]|\(dot\)) ?(?:{'|'.join(DOMAINS)})$")
    own_local = F.lower(value).rlike(r"(?:^|[._%+-])(?:example|test|noreply|no-reply)(?:$|[@._%+-])")
    hexadecimal = value.rlike(r"^(?:[0-9a-f]{20,}|[0-9A-F]{20,})$")
    mixed = value.rlike(r"[a-z]") & value.rlike(r"[A-Z]") & value.rlike(r"[0-9]")
    pattern = base_valid(kind, value) if kind in KINDS else hexadecimal | mixed
    form = {
        "email": lambda: _vote(value.rlike(r"^[A-Za-z0-9]"), value.rlike(r"\.\.|^[.-]")),
        "ip": lambda: _vote(value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), value.rlike(r"^[01]\.[0-9]\.[0-9]\.[0-9]$")),
        "card": lambda: _vote(value.rlike(r"^[0-9]{15,16}$|^[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), size < 13),
        "phone": lambda: _vote(value.rlike(r"^\+|[()]|^[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"), value.rlike(r"^[0-9.]+$")),
        "secret": lambda: _vote(F.length(value) >= 24, value.rlike(r"[/+_-].*[/+_-].*[/+_-]|^[a-z]+[0-9]+$")),
    }[kind]()
    gazetteer = {
        "email": lambda: _vote(domain, own_local),
        "ip": lambda: _vote(value.rlike(r"^(?:[1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])\."), value.rlike(r"^(?:0|22[4-9]|2[3-5][0-9])\.")),
        "card": lambda: _vote(luhn & digits.rlike(ISSUERS), ~luhn),
        "phone": lambda: _vote(value.rlike(first), ~value.rlike(r"^\+|^\(")),
        "secret": lambda: _vote(value.rlike(KEY_PREFIXES), value.rlike(r"^(?:https?|www|[a-z-]+$)")),
    }[kind]()
    context = _vote(before.rlike(_words_before(FOR[kind])), before.rlike(_words_before(AGAINST)))
    edge = _vote(before.rlike(r"[:=]\s*[\"'(]?$"), before.rlike(r"[\p{L}_.]$|[0-9][.-]$") | found["after"].rlike(r"[\p{L}_]"))
    return [_vote(pattern, ~pattern), form, gazetteer, context, edge]


def _shape(found: Column) -> Column:
    """Three bits of appearance: separators, a plus or at sign, a bracket."""
    value = found["value"]
    bit = lambda pattern, weight: F.when(value.rlike(pattern), F.lit(weight)).otherwise(F.lit(0))
    return bit(r"[\x20.-]", 1) + bit(r"[+@]", 2) + bit(r"[()\[\]]", 4)


def _word(found: Column) -> Column:
    """The class of the last word before a candidate."""
    before, number = F.lower(found["before"]), F.lit(NO_WORD)
    for i, kind in enumerate(ALL_KINDS, 1):
        number = F.when(before.rlike(_words_before(FOR[kind])), i).otherwise(number)
    return F.when(before.rlike(_words_before(AGAINST)), WORD_AGAINST).otherwise(number)


FEATURES = ("kind", *LABELERS, "shape", "word")
_SPAN = f"struct<start:int,kind:int,stop:int,{','.join(f'{name}:int' for name in FEATURES[1:])}>"


def _of_kind(text: Column, number: int, kind: str) -> tuple[Column, Column]:
    """Base spans and candidates of one kind."""

    def described(found: Column) -> Column:
        return F.struct(found["start"], F.lit(number), found["stop"], *_votes(kind, found), _shape(found), _word(found)).cast(_SPAN)

    more = F.transform(located(text, WIDER[kind], WIDER_GUARD[kind]), described)
    if kind not in BASE:
        return F.array().cast(f"array<{_SPAN}>"), more
    valid = F.filter(located(text, BASE[kind], BASE_GUARD[kind]), lambda f: base_valid(kind, f["value"]))
    return F.transform(valid, described), more


def _free(base: Column, more: Column) -> Column:
    """The candidates in `more` that touch no span in `base`; both in order.

    In the common order, a span before a candidate touches it if the furthest end so far lies behind its start, and a
    span after it if the nearest start from the other end lies before its stop.
    """
    item = "struct<start:int,first:int,span:" + _SPAN + ">"
    tag = lambda first: lambda s: F.struct(s["start"], F.lit(first), s).cast(item)

    def forward(reached: Column, m: Column) -> tuple[Column, Column]:
        is_base = m["first"] == 0
        touched = ~is_base & (reached > m["start"])
        return F.when(is_base, F.greatest(reached, m["span"]["stop"])).otherwise(reached), F.when(touched, F.lit(None)).otherwise(m)

    def backward(reached: Column, m: Column) -> tuple[Column, Column]:
        is_base = m["first"] == 0
        touched = ~is_base & (reached < m["span"]["stop"])
        return F.when(is_base, F.least(reached, m["start"])).otherwise(reached), F.when(touched, F.lit(None)).otherwise(m)

    together = F.array_sort(F.concat(F.transform(base, tag(0)), F.transform(more, tag(1))))
    there = lambda items: F.filter(items, lambda m: m.isNotNull())
    once = there(scan(together, "int", F.lit(-1), item, forward)["out"])
    twice = there(scan(F.reverse(once), "int", F.lit((1 << 31) - 1), item, backward)["out"])
    left = F.filter(F.reverse(twice), lambda m: m["first"] == 1)
    return F.when((F.size(base) > 0) & (F.size(more) > 0), F.transform(left, lambda m: m["span"])).otherwise(more)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`row` (a struct of the columns of `docs`), `base` and `more`: spans, and candidates that touch none, with votes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, more = zip(*(_of_kind(text, number, kind) for number, kind in enumerate(ALL_KINDS)))
    spans = F.struct(F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*more)).alias("more"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = with_column_once(docs.select(row, spans.alias("spans")), "spans", F.col("spans"))
    return found.select("row", F.col("spans.base").alias("base"), _free(F.col("spans.base"), F.col("spans.more")).alias("more"))


@dataclass
class Model:
    """Reliability of the labelers and weights of the span classifier."""

    prior: list[float]
    votes: dict[tuple[str, int, int], float]
    weights: dict[tuple[str, int], float]

    def probability(self, candidate: Column) -> Column:
        total = F.lit(0.0)
        for name in FEATURES:
            values = {v: w for (n, v), w in self.weights.items() if n == name}
            chosen = F.lit(0.0)
            for value, weight in values.items():
                chosen = F.when(candidate[name] == value, F.lit(weight)).otherwise(chosen)
            total = total + chosen
        return 1 / (1 + F.exp(-total))


def estimate(counts: list[tuple[tuple[int, ...], int]]) -> Model:
    """EM over `((kind, *votes, shape, word), count)`, then a logistic regression on the posteriors.

    Starts from the majority of votes. A candidate without any vote starts undecided.
    """
    n = len(LABELERS)
    truth = {key: 1 / (1 + math.exp(-2.0 * sum(key[1 : 1 + n]))) for key, _ in counts}
    prior, votes = [0.5] * len(ALL_KINDS), {}
    for _ in range(ROUNDS):
        for kind in range(len(ALL_KINDS)):
            yes = sum(c * truth[k] for k, c in counts if k[0] == kind)
            prior[kind] = (1 + yes) / (2 + sum(c for k, c in counts if k[0] == kind))
        for i, name in enumerate(LABELERS):
            for real in (0, 1):
                share = {k: c * (truth[k] if real else 1 - truth[k]) for k, c in counts}
                total = sum(share.values())
                for vote in (-1, 0, 1):
                    # A labeler is taken to be right rather than wrong before anything is seen.
                    belief = {0: 2.0, 1: 4.0 if real else 1.0, -1: 1.0 if real else 4.0}[vote]
                    met = sum(s for k, s in share.items() if k[1 + i] == vote)
                    votes[name, vote, real] = (belief + met) / (7.0 + total)
        for key in truth:
            odds = math.log(prior[key[0]] / (1 - prior[key[0]]))
            odds += sum(math.log(votes[m, key[1 + i], 1] / votes[m, key[1 + i], 0]) for i, m in enumerate(LABELERS))
            truth[key] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return Model(prior, votes, _fit(counts, truth))


def _fit(counts, truth) -> dict[tuple[str, int], float]:
    """Logistic regression by gradient steps over the distinct patterns, weighted by the root of their counts."""
    weights: dict[tuple[str, int], float] = {}
    rows = [([(name, v) for name, v in zip(FEATURES, key)], math.sqrt(c), truth[key]) for key, c in counts]
    whole = sum(w for _, w, _ in rows) or 1.0
    for _ in range(STEPS):
        slope: dict[tuple[str, int], float] = {}
        for features, weight, target in rows:
            total = sum(weights.get(f, 0.0) for f in features)
            error = weight / whole * (1 / (1 + math.exp(-total)) - target)
            for f in features:
                slope[f] = slope.get(f, 0.0) + error
        for f, s in slope.items():
            weights[f] = weights.get(f, 0.0) - RATE * (s + 1e-4 * weights.get(f, 0.0))
    return weights


def train(found: DataFrame) -> Model:
    """Train on the base spans and candidates of all rows of `find`."""
    spans = found.select(F.inline(F.concat("base", "more"))).groupBy(*FEATURES).count()
    rows = spans.limit(BOUND).collect()  # by construction there are no more
    return estimate(sorted((tuple(r[n] for n in FEATURES), r["count"]) for r in rows))


def all_spans(model: Model) -> Column:
    """Base spans and the candidates the classifier accepts, by (start, kind), as structs."""
    added = F.filter("more", lambda c: model.probability(c) > 0.5)
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["stop"]))
    return F.array_sort(F.array_distinct(F.concat(plain(F.col("base")), plain(added))))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `base`, `spans` and `secrets` (arrays of start, kind, stop; places in code points, end exclusive).

    One row per row. `spans` has the base spans and those added of the four kinds, `secrets` what looks like a key. NULL and
    empty texts hold no spans; NULL ids and repeated rows stay; other columns are not read; an empty table
    gives an empty result (and an untrained classifier, which accepts nothing). Texts are searched whole.
    """
    found = find(docs.select(F.col(id_col), F.col(text_col).alias("searched")), "searched")
    found = materialize(found.select(F.col("row")[id_col].alias(id_col), F.col("base").alias("found_base"), F.col("more").alias("found_more")))
    found = found.withColumnRenamed("found_base", "base").withColumnRenamed("found_more", "more")
    model = train(found)
    base = F.transform("base", lambda s: F.struct(s["start"], s["kind"], s["stop"]))
    both = with_column_once(found.select(id_col, base.alias("base"), all_spans(model).alias("spans")), "spans", F.col("spans"))
    return both.select(id_col, "base", F.filter("spans", lambda s: s["kind"] < SECRET).alias("spans"), _kind_is("spans", SECRET).alias("secrets"))


#: Code points of a piece that a long text is cut into, so that places are found without going over all of it.
PIECE = 1000


def _between(pieces: Column, start: Column, stop: Column) -> Column:
    """The text from one place to another, from its pieces of PIECE code points."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor(stop / PIECE).cast("int")
    piece = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    within = F.substring(piece(first), start - first * PIECE + 1, stop - start)
    middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(F.substring(piece(first), start - first * PIECE + 1, F.lit(PIECE)), middle, F.substring(piece(last), F.lit(1), stop - last * PIECE))
    return F.when(first == last, within).otherwise(across)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; spans that overlap give one, the kind of the first."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL_KINDS))
    out = "struct<from:int,start:int,kind:int>"

    def step(reached: Column, s: Column) -> tuple[Column, Column]:
        head = F.when(s["start"] >= reached, F.struct(reached, s["start"], s["kind"]).cast(out))
        return F.greatest(reached, s["stop"]), head

    def replaced(done: Column, pieces: Column) -> Column:
        heads = F.filter(done["out"], lambda h: h.isNotNull())
        parts = F.transform(heads, lambda h: F.concat(_between(pieces, h["from"], h["start"]), F.get(names, h["kind"])))
        return F.concat(F.array_join(parts, ""), _between(pieces, done["state"], F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    whole = _once(scan(spans, "int", F.lit(0), out, step), lambda done: _once(pieces, lambda pieces: replaced(done, pieces)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All documents with their personal data and keys replaced; columns as they were, whatever their names.

    The classifier is trained on all rows; they are searched once for its counts and once for their spans, as storing
    what was found would store all texts. A column `n_chars` is counted anew. NULL and empty texts, repeated rows and NULL ids
    stay as they are; an empty table stays empty.
    """
    model = train(find(docs.select(text_col), text_col))
    found = find(docs, text_col)
    cleaned = with_column_once(
        found.select("row", redacted(F.col("row")[text_col], all_spans(model)).alias("cleaned")), "cleaned", F.col("cleaned")
    )
    made = {text_col: F.col("cleaned")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.coalesce(F.length("cleaned").cast(docs.schema["n_chars"].dataType), F.col("row")["n_chars"])
    return cleaned.select(*(made.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def _kind_is(spans: str, number: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == number)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = detect(docs)
    counts = [F.size(_kind_is("base", i)).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        (F.size("spans") + F.size("secrets")).cast("long").alias("n_spans"),
        listed(F.col("secrets")).alias("secrets"),
    )
