"""Personal data by weak supervision.

1. Candidates: each kind has patterns, wide ones included. Base candidates (strict pattern and its check)
   always are spans. Offsets come from the lengths of a text's pieces between matches. A wide candidate that overlaps a base
   one says nothing new and goes before anything is counted.
2. Labelers vote yes (1), no (0) or abstain (-1) on a candidate: its shape (pattern and checks), a gazetteer
   (domains, address ranges, issuers, country codes, given names, street words, places), what is said before it and after it, and
   the characters on either side.
3. Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability for each kind and each
   kind's share of true candidates, hence a probability for each pattern. Base candidates are true throughout, which anchors it.
4. A logistic classifier is trained on those probabilities. It sees the text alone, not the votes: kind, outline,
   length, checksum and neighbours. Other candidates it accepts become spans too.

Texts are read once, by built-in functions only. Vote patterns (3 ** 5 for a kind) and features (OUTLINES * 5 * 9 * 2 for a kind) are
bounded by construction, so the driver fits both models on their counts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, stored

KINDS = ("email", "ip", "card", "phone", "ssn", "name", "address")
LOCAL = "A-Za-z0-9._%+-"
#: Possessive quantifiers change no match here, as nothing that follows could use what they hold; they keep
#: the matcher from recursing. A look-behind or the end of the last match spares starts inside a run.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wide patterns. Where a base match could hold a wide one, the pattern takes base matches too, and they are left out.
WORDED_EMAIL = rf"(?i)(?<![{LOCAL}])[{LOCAL}]++(?:@[A-Za-z0-9.-]++|\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[A-Za-z0-9-]++)++)"
LOCAL_PHONE = rf"{PHONE}|(?<![0-9+(.-])(?:\([0-9]{{3}}\)\x20?|[0-9]{{3}}[\x20.-])[0-9]{{3}}[\x20.-][0-9]{{4}}(?![0-9-])"
SSN = r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9.-])"

#: Gazetteers.
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "at", "ch", "fr", "be", "es", "mx", "ar", "it", "nl", "uk", "us", "ca", "au", "eu")
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "420", "972")
GIVEN_NAMES = (
    "Alice Andrew Anna Anne Anthony Barbara Brian Carol Charles Christopher Daniel David Deborah Donald Dorothy Edward Elizabeth Emily Emma George Helen Jack James "
    "Jane Jennifer Jessica John Joseph Karen Kevin Laura Linda Lisa Margaret Maria Mark Mary Matthew Michael Nancy Oliver Patricia Paul Peter Richard Robert Ruth Sarah "
    "Steven Susan Thomas William Andreas Claudia Dieter Frank Franz Hans Heike Heinrich Jürgen Karin Karl Klaus Matthias Monika Petra Sabine Stefan Ursula Uwe "
    "Wolfgang Antoine Camille Catherine Chantal Claude Émilie François Françoise Hélène Henri Isabelle Jacques Jean Julien Luc Marie Mathieu Michel Nicolas Nathalie "
    "Pierre Sophie Alejandro Ana Antonio Carlos Carmen Diego Elena Fernando Francisco Isabel Javier José Juan Lucía Luis Manuel Marta Miguel Pablo Pedro Pilar Rosa Sofía"
).split()
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Herrn", "Frau", "Monsieur", "Madame", "Mme", "Mlle", "Señor", "Señora", "Sr", "Sra", "Don", "Doña")
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Ln", "Drive", "Dr", "Boulevard", "Blvd", "Court", "Square", "Terrace", "Way")
STREETS_BEFORE = ("rue", "avenue", "boulevard", "place", "chemin", "impasse", "calle", "avenida", "plaza", "paseo")
PLACES = (
    "Amsterdam Athens Atlanta Barcelona Bath Berlin Birmingham Bordeaux Boston Bremen Bristol Brussels Cambridge Chicago Cologne Dallas Denver Detroit Dresden Dublin "
    "Edinburgh Frankfurt Geneva Glasgow Granada Hamburg Hannover Houston Köln Leeds Leipzig Lille Lisbon Liverpool London Lyon Madrid Manchester Marseille Miami Montréal "
    "München Munich Nantes Nice Nürnberg Oxford Paris Philadelphia Rome Salamanca Seattle Sevilla Stuttgart Toronto Toulouse Valencia Vienna Wien Zaragoza Zürich"
).split()
_CAP = r"\p{Lu}[\p{Ll}'’-]++"
NAME = rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:(?:{'|'.join(TITLES)})\.?\x20){_CAP}(?:\x20{_CAP}){{0,2}}|(?:{'|'.join(GIVEN_NAMES)})\x20(?:\p{{Lu}}\.\x20)?{_CAP})"
ADDRESS = (
    rf"(?<![\p{{L}}\p{{N}}])(?:[0-9]{{1,5}}\x20(?:{_CAP}\x20){{1,3}}(?:{'|'.join(STREETS)})(?!\p{{L}})|[0-9]{{1,4}},?\x20(?:{'|'.join(STREETS_BEFORE)})\x20[\p{{L}}'’\x20-]{{2,30}}\p{{L}}"
    rf"|(?=\p{{Lu}})\p{{L}}+(?:(?<=straße|strasse)|(?<=weg|allee)|(?<=platz))\x20[0-9]{{1,4}}(?![0-9]))"
)
#: What is said before and after the kinds, and before and after what only looks like them.
HINTS = {
    "email": "mail|contact|write|reach|from:|to:|courriel|correo",
    "ip": r"\bip\b|address|host|server|login|client|connect|adresse",
    "card": "card|visa|master|amex|credit|payment|account|konto|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|contact|reach|anruf|mobil|appel|llame",
    "ssn": r"ssn|social|security|\btax",
    "name": r"name|contact|dear|sincerely|regards|signed|author|by$|from:|to:|appelle|llamo|heiße",
    "address": r"address|live|located|visit|ship|deliver|adresse|anschrift|dirección|wohn|habit",
}
HINTS_AFTER = {
    "email": "or call|for more|for details",
    "ip": r"^\W{0,2}(?:port|logged|connected|requested)",
    "card": r"^\W{0,2}(?:exp|cvv|cvc|valid)",
    "phone": r"^\W{0,2}(?:ext|or e-?mail|\((?:mobile|home|work|office)\))",
    "ssn": r"^\W{0,2}(?:dob|born|issued)",
    "name": r"^\W{0,2}(?:wrote|said|lives|\(?born|phone|tel|e-?mail|@)",
    "address": rf"^,?\W{{0,2}}(?:[0-9]{{5}}|apt|suite|{'|'.join(p.lower() for p in PLACES)})",
}
AGAINST = r"version|release|isbn|issn|order|invoice|serial|section|figure|page|\bno\.|part number|sku|chapter|street|avenue|saint|university"
AGAINST_AFTER = r"^\W{0,2}(?:pages|words|bytes|units|items|km\b|kg\b|university|theatre|airport|street|award|prize)"
#: Votes a candidate gets, in the order of its `votes` array.
LABELERS = ("shape", "gazetteer", "before", "after", "edges")
#: For each labeler: yes when true, yes when false. They weigh PRIOR_VOTES votes, which a few candidates outweigh.
PRIOR = ((0.95, 0.3), (0.8, 0.4), (0.9, 0.2), (0.9, 0.2), (0.9, 0.6))
PRIOR_VOTES, OUTLINES = 4, 32


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, for expressions that name it more than once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(lengths: Column, block: int = 256) -> Column:
    """Sums of the elements before each element, and of all at last. Folds run by block, so long arrays cost no square."""
    zero = F.array(F.lit(0).cast("long"))
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, block))
    add = lambda done, v: F.concat(done, F.array(F.element_at(done, -1) + v))
    inner = F.transform(blocks, lambda x: F.aggregate(x, zero, add))

    def joined(parts: Column) -> Column:
        starts = F.aggregate(parts, zero, lambda done, p: F.concat(done, F.array(F.element_at(done, -1) + F.element_at(p, -1))))
        whole = lambda s: F.flatten(F.zip_with(parts, F.slice(s, 1, F.size(parts)), lambda p, o: F.transform(F.slice(p, 1, F.size(p) - 1), lambda v: v + o)))
        return bound(starts, whole)

    return bound(inner, joined)


def found(text: Column, pattern: str, guard: Column) -> Column:
    """Leftmost non-overlapping matches as (start, end, match), code points, end exclusive."""
    none = F.array().cast("array<struct<start:long,end:long,match:string>>")

    def located(pieces: Column, matches: Column) -> Column:
        lengths = F.flatten(F.zip_with(pieces, matches, lambda p, m: F.array(F.length(p).cast("long"), F.coalesce(F.length(m), F.lit(0)).cast("long"))))
        place = lambda sums: F.transform(matches, lambda m, i: F.struct(F.get(sums, 2 * i + 1).alias("start"), (F.get(sums, 2 * i + 1) + F.length(m)).alias("end"), m.alias("match")))
        return bound(running(lengths), place)

    whole = bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(bound(F.split(text, pattern, -1), lambda p: located(p, m))))
    return F.when(guard, whole).otherwise(none)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a Luhn sum that ends in 0."""
    n = F.length(number)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(number.substr(n - i + 1, F.lit(1))) - 48
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid_card(match: Column) -> Column:
    return bound(digits(match), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


def valid_ip(match: Column) -> Column:
    part = lambda p: bound(F.ltrim(p, F.lit("0")), lambda q: F.when(F.length(q) <= 3, F.concat(F.lit("0"), q).cast("int") <= 255).otherwise(F.lit(False)))
    return F.forall(F.split(match, r"\."), part)


def valid_phone(match: Column) -> Column:
    return F.length(digits(match)).between(9, 15)


def vote(yes: Column, no: Column | None = None) -> Column:
    """1 for yes, 0 for no; without `no` what isn't yes is no, with it the rest abstains."""
    out = F.when(yes, 1)
    return (out.otherwise(0) if no is None else out.when(no, 0).otherwise(-1)).cast("int")


def gazetteer(kind: str, match: Column, after: Column) -> Column:
    if kind == "email":
        return vote(F.lower(match).rlike(rf"(?:\.|dot\s?[\])]\s?)(?:{'|'.join(DOMAIN_ENDS)})$"), F.lit(False))
    if kind == "ip":
        return vote(match.rlike(r"^(?:10|127|172|192)\."), match.rlike(r"^0"))
    if kind == "card":
        return vote(digits(match).rlike("^[3-6]"))
    if kind == "phone":
        return vote(match.rlike(rf"^\+(?:{'|'.join(COUNTRY_CODES)})"), match.rlike(r"^\(?[01]"))
    if kind == "ssn":
        return vote(~match.rlike("^(?:000|666|9)"))
    if kind == "name":
        return vote(match.rlike(rf"(?:^|\x20)(?:{'|'.join(GIVEN_NAMES)})\x20"), F.lit(False))
    return vote(after.rlike(rf"^\W{{0,9}}[0-9]{{0,5}}\W{{0,2}}(?:{'|'.join(PLACES)})(?!\p{{L}})"), F.lit(False))


def outline(match: Column) -> Column:
    """What a match looks like: runs of letters as a or A (by their first), of digits as 9, the rest as it is; one of OUTLINES."""
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace(match, r"\p{Ll}[\p{L}'’]*", "a"), r"\p{Lu}[\p{L}'’]*", "A"), "[0-9]+", "9")
    return F.pmod(F.xxhash64(shown), F.lit(OUTLINES)).cast("int")


def described(text: Column, kind: str, base: Callable, shape: Callable) -> Callable[[Column], Column]:
    """What makes a candidate of a match in a text."""
    word = "[\\p{L}\\p{N}_]"

    def side(x: Column) -> Column:
        return F.when(x.rlike(word), "w").when(x.rlike("\\S"), "p").otherwise("s")

    def described_match(c: Column) -> Column:
        m = c["match"]
        first = F.greatest(c["start"] - 39, F.lit(1)).cast("int")
        prior = F.lower(text.substr(first, (c["start"] + 1 - first).cast("int")))
        later = text.substr((c["end"] + 1).cast("int"), F.lit(30))
        before = text.substr(c["start"].cast("int"), F.when(c["start"] > 0, 1).otherwise(0))
        after = text.substr((c["end"] + 1).cast("int"), F.lit(1))
        edges = vote(~before.rlike(word) & ~after.rlike(word))
        votes = [
            vote(shape(m)),
            gazetteer(kind, m, later),
            vote(prior.rlike(HINTS[kind]), prior.rlike(AGAINST)),
            vote(F.lower(later).rlike(HINTS_AFTER[kind]), F.lower(later).rlike(AGAINST_AFTER)),
            edges,
        ]
        check = luhn(digits(m)) if kind == "card" else F.lit(True)
        return F.struct(
            F.lit(kind).alias("kind"),
            c["start"].alias("start"),
            c["end"].alias("end"),
            base(m).alias("base"),
            F.array(*votes).alias("votes"),
            outline(m).alias("outline"),
            side(before).alias("before"),
            side(after).alias("after"),
            F.least(F.floor(F.length(m) / 6), F.lit(4)).cast("int").alias("size"),
            check.alias("check"),
        )

    return described_match


def candidates(text: Column) -> Column:
    """All candidates of a text as (kind, start, end, base, votes, outline, before, after, size, check)."""
    has_digit = text.rlike("[0-9]")
    low_at = text.rlike(r"(?i)[\[(]\x20?at\x20?[\])]")
    yes = lambda m: F.lit(True)
    no = lambda m: F.lit(False)
    plausible = lambda c: F.length(digits(c["match"])).between(13, 19)
    other = lambda sign: lambda c: ~F.contains(c["match"], F.lit(sign))
    # Guards are what any candidate holds, and cheaper to look for.
    # kind, pattern, guard, which matches are candidates, which of these are base, whether the shape is right
    sources = [
        ("email", EMAIL, F.contains(text, F.lit("@")), yes, yes, yes),
        ("ip", IP, has_digit & text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), yes, valid_ip, valid_ip),
        ("card", CARD, has_digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), plausible, valid_card, valid_card),
        ("phone", PHONE, F.contains(text, F.lit("+")), yes, valid_phone, valid_phone),
        ("email", WORDED_EMAIL, low_at, other("@"), no, yes),
        ("phone", LOCAL_PHONE, has_digit & text.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), other("+"), no, yes),
        ("ssn", SSN, has_digit & text.rlike("-[0-9]{2}-"), yes, no, lambda m: ~m.rlike("-00-|-0000$")),
        ("name", NAME, text.rlike(NAME), yes, no, lambda m: ~m.rlike(r"(?i)(\p{L}+)\x20\1$")),
        ("address", ADDRESS, has_digit & text.rlike(ADDRESS), yes, no, lambda m: m.rlike(r"[1-9]")),
    ]
    return F.concat(*[F.transform(F.filter(found(text, pattern, guard), worth), described(text, kind, base, shape)) for kind, pattern, guard, worth, base, shape in sources])


def estimate(patterns: list[tuple[str, tuple[int, ...], int, int]], rounds: int = 60) -> tuple[dict, dict, dict]:
    """EM over (kind, votes, candidates, those that are known to be true): probabilities of the others by (kind, votes), the share of
    true ones among them by kind, and reliabilities by (kind, labeler's number) as (yes when true, yes when false) among votes that
    aren't abstentions.

    PRIOR is where reliabilities start, and weighs PRIOR_VOTES imagined votes."""
    share = dict.fromkeys({k for k, *_ in patterns}, 0.5)
    rely = {(k, i): PRIOR[i] for k in share for i in range(len(PRIOR))}
    true: dict = {}
    for _ in range(rounds):
        for kind, votes, *_ in patterns:
            yes, no = math.log(share[kind]), math.log(1 - share[kind])
            for i, v in enumerate(votes):
                a, b = rely[kind, i]
                if v >= 0:
                    yes, no = yes + math.log(a if v else 1 - a), no + math.log(b if v else 1 - b)
            true[kind, votes] = 1 / (1 + math.exp(max(-60.0, min(60.0, no - yes))))
        for kind in share:
            own = [(v, true[k, v], n, known) for k, v, n, known in patterns if k == kind]
            share[kind] = (1 + sum(p * (n - known) for _, p, n, known in own)) / (2 + sum(n - known for *_, n, known in own))
            for i, (a0, b0) in enumerate(PRIOR):
                cast = [(v[i], known + p * (n - known), (1 - p) * (n - known)) for v, p, n, known in own if v[i] >= 0]
                good, bad = PRIOR_VOTES + sum(y for _, y, _ in cast), PRIOR_VOTES + sum(x for *_, x in cast)
                rely[kind, i] = (a0 * PRIOR_VOTES + sum(y for v, y, _ in cast if v)) / good, (b0 * PRIOR_VOTES + sum(x for v, _, x in cast if v)) / bad
    return true, share, rely


#: What the classifier sees of a candidate, besides its kind.
SEEN = ("outline", "size", "before", "after", "check")


def named(kind: str, *seen) -> list[str]:
    """Features of a candidate."""
    return [f"kind={kind}", *[f"{kind}:{n}={v}" for n, v in zip(SEEN, seen)]]


def classifier(rows: list[tuple[list[str], float, float]], steps: int = 200, rate: float = 2.0, decay: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic regression on (features, how many are true, how many false), by gradient descent.

    A kind's features are its own, so each kind is fitted by itself, to its own number of candidates."""
    weights = dict.fromkeys([f for features, _, _ in rows for f in features], 0.0)
    total: dict[str, float] = {}
    for features, yes, no in rows:
        total[features[0]] = total.get(features[0], 0.0) + yes + no
    for _ in range(steps):
        slope = dict.fromkeys(weights, 0.0)
        for features, yes, no in rows:
            guess = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(weights[f] for f in features)))))
            pull = (guess * no - (1 - guess) * yes) / total[features[0]]
            for f in features:
                slope[f] += pull
        for f in weights:
            weights[f] -= rate * (slope[f] + decay * weights[f])
    return weights


def lookup(table: dict, name: Column, default: float) -> Column:
    """The value a name has in a table of a bounded size, as a literal map."""
    if not table:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.from_json(F.lit(json.dumps(table)), "map<string,double>"), name), F.lit(default))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`, an array of (kind_no, start, end, kind, base) by kind as listed, then start.

    Null and empty texts have none. Repeated rows are scanned each; an empty table gives no rows (and no
    models); other columns are ignored, whatever they are called. Base candidates are always in; others if the classifier
    gives them an even chance and they overlap no base span.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    folder = scratch(docs.sparkSession)
    located = docs.select("doc_id", candidates(text).alias("found"))
    located = located.select("doc_id", F.filter("found", lambda c: c["base"]).alias("base"), F.filter("found", lambda c: ~c["base"]).alias("wide"), F.monotonically_increasing_id().alias("row"))
    located = stored(located, folder, "candidates", all_tasks=True)

    # Wide candidates apart from base spans: by the furthest end of those that begin before, and the next beginning.
    alone = located.filter((F.size("wide") > 0) & (F.size("base") == 0)).select("row", F.explode("wide").alias("c"))
    mixed = located.filter((F.size("wide") > 0) & (F.size("base") > 0)).select("row", F.explode(F.concat("base", "wide")).alias("c"))
    by_start = Window.partitionBy("row").orderBy(F.col("c.start"), F.col("c.base").desc())
    ended = F.max(F.when(F.col("c.base"), F.col("c.end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(F.col("c.base"), F.col("c.start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    apart = (F.coalesce(ended, F.lit(0)) <= F.col("c.start")) & (F.coalesce(begins, F.col("c.end")) >= F.col("c.end"))
    mixed = mixed.withColumn("apart", apart).filter("apart AND NOT c.base").select("row", "c")
    wide = stored(alone.unionByName(mixed), folder, "wide")

    base = located.select(F.explode("base").alias("c")).select("c.*")
    every = base.unionByName(wide.select("c.*"))
    counts = every.groupBy("kind", "votes").agg(F.count("*"), F.count_if("base")).orderBy("kind", "votes").collect()
    true, _, _ = estimate([(r[0], tuple(r[1]), r[2], r[3]) for r in counts])
    table = {f"{k}:{','.join(map(str, v))}": p for (k, v), p in true.items()}
    p = F.when(F.col("base"), 1.0).otherwise(lookup(table, F.concat_ws(":", "kind", F.array_join(F.col("votes").cast("array<string>"), ",")), 0.0))
    features = every.groupBy("kind", *SEEN).agg(F.sum(p), F.sum(1 - p)).orderBy("kind", *SEEN).collect()
    weights = classifier([(named(*r[:6]), r[6], r[7]) for r in features])

    def score(c: Column) -> Column:
        # A boolean is named as Python names it.
        value = lambda n: F.initcap(c[n].cast("string")) if n == "check" else c[n].cast("string")
        names = [F.concat(F.lit("kind="), c["kind"]), *[F.concat(c["kind"], F.lit(f":{n}="), value(n)) for n in SEEN]]
        return sum((lookup(weights, n, 0.0) for n in names[1:]), lookup(weights, names[0], 0.0))

    numbers = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    shape = lambda c: F.struct(F.element_at(numbers, c["kind"]).alias("kind_no"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"))
    # A text's own spans only.
    added = wide.filter(score(F.col("c")) >= 0).groupBy("row").agg(F.collect_list(shape(F.col("c"))).alias("more"))
    both = located.select("doc_id", "row", F.transform("base", shape).alias("own")).join(added, "row", "left")
    return both.select("doc_id", F.array_sort(F.concat("own", F.coalesce("more", F.slice("own", 1, 0)))).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, the SHA-256 of their list, the list of all spans, and how many these are.

    Nulls, empty texts, repeated rows and empty tables as in `spans`.
    """
    listed = lambda x: F.array_join(F.transform(x, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")
    base = F.filter("spans", lambda c: c["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda c: c["base"] & (c["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:4]]
    n = F.size("spans").cast("long")
    return spans(docs).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), n.alias("n_spans"), (n > 0).alias("personal"))
