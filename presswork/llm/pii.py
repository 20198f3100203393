"""Personal data: span generators, boosted trees over candidates, redaction. DataFrame code only.

Base kinds (email, ip, card, phone) are spans of fixed patterns with fixed checks; they always stay.
Generators of high recall propose more spans, which may overlap each other: written-out mail addresses, phone
numbers without a plus sign, national insurance numbers, bank accounts, keys and tokens. For each
candidate, boosted trees weigh its format and the words around it; a candidate is kept from its
kind's calibrated threshold on, unless another span covers it. Each kind's trees are fitted here, on
candidates from generated sentences (a fixed seed and count), and are applied as CASE expressions.

Positions are code points, ends exclusive. Whole texts are searched, in linear time: patterns start
only where a run starts and never give characters back.
"""

from __future__ import annotations

import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.llm.common import running, running_sums

BASE_KINDS = ("email", "ip", "card", "phone")
#: Patterns of the base kinds; \G lets a match begin where the last one ended.
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind's pattern to be worth a search.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_SHAPES = {"ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){5}"}
EXTRA = {
    "email_words": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,64}+ ?[\[(]? ?at ?[\])]? ?[a-z0-9-]{2,63}+ ?[\[(]? ?dot ?[\])]? ?[a-z]{2,10}+(?![a-z0-9])",
    "phone_local": r"(?<![0-9+(-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+",
}
#: What a text must match for a kind's pattern to be worth a search: every match of the pattern holds it.
_EXTRA_NEEDS = {"email_words": r"(?i)at[\[\]() a-z0-9-]{2,69}dot", "phone_local": r"[0-9]{3}[ .-][0-9]{3}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "iban": r"[A-Z]{2}[0-9]{2}[ 0-9A-Z]", "secret": r"[A-Za-z0-9_-]{20}"}
_CUES = {"email_words": r"mail|conta[ck]t|write|reach|courriel|écri|schreib|kontakt|correo|escrib", "phone_local": r"phone|tel|tél|call|mobile|fax|dial|appel|anruf|llam", "ssn": r"ssn|social|security|insurance|sécu|sozial|segur", "iban": r"iban|account|bank|banque|banco|transfer|konto|compte|cuenta", "secret": r"key|token|secret|passw|auth|bearer|credential|clé|jeton|schlüssel|clave|contraseña"}
#: Formats that speak for a kind by themselves; bank accounts have a check sum instead, secrets none.
_FORMATS = {
    "email_words": r"(?i)dot ?[\])]? ?(?:com|org|net|edu|gov|info|io|eu|us|uk|de|fr|es|it|nl|ch)$",
    "phone_local": r"^(?:\([0-9]{2,4}\)[ .-][0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|0[0-9]{1,3}[ .-][0-9]{3,4}[ .-][0-9]{3,4})$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
}
AROUND = 32


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the check sum: every second one from the right doubled, its digits added."""
    turned = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(F.filter(turned, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _mod97(value: Column) -> Column:
    """Whether the check sum of an account number holds: country and check digits go last, letters count from 10."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    signs = F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), "")
    step = lambda a, c: F.when(c == "", a).when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(signs, F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return n.between(12, 19) & F.when(n.between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def with_base_spans(docs: DataFrame, text: str, to: str) -> DataFrame:
    """Adds ``to``: the base spans as sorted (start, rank of kind, kind, end)."""
    for rank, kind in enumerate(BASE_KINDS):
        cheap = F.contains(F.col(text), F.lit(_NEEDS[kind])) if _NEEDS[kind] else F.lit(True)
        if kind in _SHAPES:
            cheap = cheap & F.col(text).rlike(_SHAPES[kind])
        docs = _search(docs, text, cheap, BASE[kind], f"_{kind}")
        docs = docs.withColumn(f"_{kind}", _base_spans(rank, kind))
    names = [f"_{kind}" for kind in BASE_KINDS]
    return docs.withColumn(to, F.array_sort(F.concat(*names))).drop(*names)


def _base_spans(rank: int, kind: str) -> Column:
    found = F.filter(f"_{kind}", lambda m: _valid(kind, m["value"]))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _search(docs: DataFrame, text: str, cheap: Column, pattern: str, to: str) -> DataFrame:
    """Adds ``to``: array of (start, end, value) of the pattern's matches where ``cheap`` holds."""
    body = F.when(cheap, F.col(text)).otherwise("")
    docs = docs.withColumn("_m", F.regexp_extract_all(body, F.lit(pattern), F.lit(0)))
    gaps = F.split(F.when(F.size("_m") > 0, F.col(text)).otherwise(""), pattern, -1)
    sizes = F.flatten(F.zip_with(F.slice(gaps, F.lit(1), F.size("_m")), F.col("_m"), lambda g, m: F.array(F.length(g).cast("long"), F.length(m).cast("long"))))
    docs = docs.withColumn("_at", F.when(F.size("_m") > 0, running_sums(sizes)).otherwise(F.array(F.lit(0).cast("long"))))
    found = F.transform("_m", lambda m, i: F.struct(F.get("_at", 2 * i + 1).alias("start"), F.get("_at", 2 * i + 2).alias("end"), m.alias("value")))
    return docs.withColumn(to, found).drop("_m", "_at")


FEATURES = ("length", "digits", "uppers", "hexes", "marks", "kinds_of_letters", "cue", "cue_near", "quoted", "assigned", "vowels", "valid", "switches")


def features(kind: Column, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format of the candidate and its context, as numbers."""
    n = F.length(value)
    share = lambda rx: F.length(F.regexp_replace(value, f"[^{rx}]", "")) / n
    cue = F.lit(False)
    near = F.lit(False)
    for k, rx in _CUES.items():
        cue = F.when(kind == k, before.rlike(f"(?i){rx}")).otherwise(cue)
        near = F.when(kind == k, F.right(before, F.lit(12)).rlike(f"(?i)(?:{rx})")).otherwise(near)
    valid = F.when(kind == "iban", _mod97(value)).otherwise(F.lit(False))
    for k, rx in _FORMATS.items():
        valid = F.when(kind == k, value.rlike(rx)).otherwise(valid)
    switches = F.regexp_count(value, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]")) / n
    kinds = sum((value.rlike(rx).cast("int") for rx in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
    out = [n, share("0-9"), share("A-Z"), share("0-9a-fA-F"), share("^A-Za-z0-9"), kinds, cue, near, before.rlike("[\"'`]$") & after.rlike("^[\"'`]"), before.rlike("[:=]\\s*[\"'`]?$"), share("aeiouAEIOU"), valid, switches]
    return {name: c.cast("double") for name, c in zip(FEATURES, out, strict=True)}


#: Generated candidates, trees a kind, depth, rate and seed of the fit; precision asked of the held-out part.
EXAMPLES, TREES, DEPTH, RATE, SEED, PRECISION = 12_000, 24, 2, 0.4, 11, 0.97


#: Letters of the corpus's languages, and words that announce each kind in them.
_LETTERS = ("aeioutnrslhd", "aeiouéèàçtnrsl", "aeioutnrslhdüöß", "aeioutnrslhdñóá")
_OPENERS = {
    "email_words": ["mail me: ", "contact ", "write to ", "courriel : ", "écrivez à ", "schreiben Sie an ", "correo: "],
    "phone_local": ["phone ", "Tel: ", "call me at ", "téléphone ", "appelez le ", "Anruf unter ", "llame al "],
    "ssn": ["SSN ", "social security no. ", "sécurité sociale ", "Sozialversicherung ", "seguro social "],
    "iban": ["IBAN ", "account: ", "bank transfer to ", "compte ", "Konto ", "cuenta "],
    "secret": ['token = "', "api_key: ", "password=", "secret = '", "clé : ", "Schlüssel: ", "contraseña: "],
}
_NEUTRAL = ["", "", "", "(", ": ", '"', "x = ", "x = '", 'value: "', "no. "]


def examples() -> list[tuple[str, str, str, str, int]]:
    """(kind, value, before, after, label): sentences with personal data, and look-alikes without.

    Either has an announcing word before it as often as not, so that the format decides; only account
    numbers whose check sum fails need such a word."""
    rng = random.Random(SEED)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    mixed = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    word = lambda a="aeioutnrslhd", most=9: mixed(rng.randint(2, most), a)
    hexes, base32 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def account(right: bool) -> str:
        country, size, signs = rng.choice([("DE", 18, "0123456789"), ("ES", 20, "0123456789"), ("FR", 23, "0123456789"), ("GB", 18, "ABCDEFGHIKLMNOPRSTW0123456789"), ("IT", 23, "0123456789")])
        body = mixed(size, signs)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        whole = f"{country}{check if right else (check + rng.randint(1, 90)) % 97:02d}{body}"
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if not right or rng.random() < 0.5 else whole

    def personal(kind: str, cued: bool) -> str:
        if kind == "email_words":
            at, dot = rng.choice([(" at ", " dot "), (" (at) ", " (dot) "), (" [at] ", " [dot] ")])
            return f"{word()}{rng.choice(['.', '_', ''])}{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io'])}"
        if kind == "phone_local":
            gap = rng.choice(" .-")
            return rng.choice([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}{gap}{digits(3)}{gap}{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)} {digits(3)} {digits(3)}"])
        if kind == "ssn":
            return f"{rng.choice([rng.randint(1, 665), rng.randint(667, 899)]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        if kind == "iban":
            return account(not cued or rng.random() < 0.6)
        return rng.choice([mixed(rng.choice([32, 40, 64]), hexes), mixed(rng.choice([32, 40, 64]), hexes), mixed(rng.randint(24, 64), letters), mixed(rng.randint(100, 400), letters), "AKIA" + mixed(16, base32), rng.choice(["sk-", "ghp_"]) + mixed(rng.randint(30, 48), letters), mixed(rng.randint(24, 64), letters + "-_")])

    def alike(kind: str) -> str:
        if kind == "email_words":
            return f"{word()} at {word()} dot {word() + rng.choice('aeiou')}"
        if kind == "phone_local":
            gap = rng.choice(" .")
            return rng.choice([f"{rng.randint(100, 999)}{gap}{digits(3)}{gap}{digits(3)}", f"{rng.randint(10, 99)}{gap}{digits(3)}{gap}{digits(3)}", f"{rng.randint(1000, 9999)}.{digits(3)}.{digits(3)}", " ".join(str(rng.randint(1900, 2030)) for _ in range(3))])
        if kind == "ssn":
            return rng.choice([f"000-{digits(2)}-{digits(4)}", f"666-{digits(2)}-{digits(4)}", f"9{digits(2)}-{digits(2)}-{digits(4)}", f"{digits(3)}-00-{digits(4)}", f"{digits(3)}-{digits(2)}-0000"])
        if kind == "iban":
            return mixed(2, "ABCXYZ") + digits(2) + rng.choice([mixed(12, "ABCXYZ0123456789"), mixed(16, "ABCXYZ0123456789"), "".join(" " + mixed(4, "ABCDEFGHIKLMNOPRSTW") for _ in range(4))])
        many = [word(most=8) for _ in range(6)]
        return rng.choice([mixed(rng.randint(22, 60), "aeioutnrslhd"), "-".join(many[:5]).ljust(20, "a") + "-" + str(rng.randint(1900, 2030)), "_".join(many).ljust(20, "a"), "".join(w.capitalize() for w in many).ljust(20, "a"), "_".join(many).upper().ljust(20, "A"), rng.choice("-_=x") * rng.randint(20, 90), digits(rng.randint(20, 40)), f"{rng.randint(1990, 2030)}-{digits(2)}-{digits(2)}-{digits(2)}-{digits(2)}-{digits(2)}-{word()}", f"{mixed(8, hexes)}-{mixed(4, hexes)}-{mixed(4, hexes)}-{mixed(4, hexes)}-{mixed(12, hexes)}"])

    out = []
    for i in range(EXAMPLES):
        kind, good = list(EXTRA)[i % len(EXTRA)], (i // len(EXTRA)) % 2
        own, cued = rng.choice(_LETTERS), rng.random() < 0.5
        plain = lambda a=own: " ".join(word(a) for _ in range(6)) + " "
        before = plain() + rng.choice(_OPENERS[kind] if cued else _NEUTRAL)
        value = personal(kind, cued) if good else alike(kind)
        after = (before[-1] if before[-1] in "\"'" else "") + rng.choice([" ", ". ", ", "]) + plain()
        out.append((kind, value, before[-AROUND:], after[:AROUND], good))
    return out


def grow(x: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int) -> tuple | float:
    """A regression tree on second-order gains: (feature, limit, below, above), or a leaf's step."""
    leaf = float(RATE * gradient.sum() / (weight.sum() + 1.0))
    if depth == 0 or len(x) < 20:
        return leaf
    best = (1e-6, None, None)
    whole = gradient.sum() ** 2 / (weight.sum() + 1.0)
    for f in range(x.shape[1]):
        for limit in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 19))):
            low = x[:, f] <= limit
            if 10 <= low.sum() <= len(x) - 10:
                gain = sum(gradient[s].sum() ** 2 / (weight[s].sum() + 1.0) for s in (low, ~low)) - whole
                if gain > best[0]:
                    best = (gain, f, float(limit))
    _, f, limit = best
    if f is None:
        return leaf
    low = x[:, f] <= limit
    return f, limit, grow(x[low], gradient[low], weight[low], depth - 1), grow(x[~low], gradient[~low], weight[~low], depth - 1)


def applied(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, limit, below, above = tree
    return np.where(x[:, f] <= limit, applied(below, x), applied(above, x))


def as_column(tree: tuple | float, row: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, limit, below, above = tree
    return F.when(row[FEATURES[f]] <= limit, as_column(below, row)).otherwise(as_column(above, row))


@cache
def _model(spark: SparkSession) -> tuple[dict[str, list], dict[str, float]]:
    """(trees, threshold) by kind: fitted on two thirds of the kind's generated candidates, calibrated on the rest."""
    made = spark.createDataFrame(examples(), "kind string, value string, before string, after string, label int")
    f = features(F.col("kind"), F.col("value"), F.col("before"), F.col("after"))
    rows = made.select("kind", "label", *[c.alias(k) for k, c in f.items()]).collect()
    trees, limits = {}, {}
    for kind in EXTRA:
        own = [r for r in rows if r.kind == kind]
        x = np.array([[r[k] for k in FEATURES] for r in own])
        y = np.array([r.label for r in own], float)
        fit = np.arange(len(x)) % 3 != 0
        score, trees[kind] = np.zeros(len(x)), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            trees[kind].append(grow(x[fit], (y - p)[fit], (p * (1 - p))[fit], DEPTH))
            score += applied(trees[kind][-1], x)
        order = np.argsort(-score[~fit])
        right = np.cumsum(y[~fit][order]) / np.arange(1, (~fit).sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        limits[kind] = max(0.0, float(score[~fit][order][good[-1]])) if len(good) else float("inf")
    return trees, limits


def _weighed(rank: int, kind: str, trees: list, limit: float) -> Column:
    """The candidates of a kind that reach its threshold, as spans."""

    def scored(m: Column) -> Column:
        before = F.substr(F.col("body"), F.greatest(m["start"] - AROUND + 1, F.lit(1)).cast("int"), F.least(m["start"], F.lit(AROUND)).cast("int"))
        after = F.substr(F.col("body"), (m["end"] + 1).cast("int"), F.lit(AROUND))
        f = F.struct(*[c.alias(k) for k, c in features(F.lit(kind), m["value"], before, after).items()])
        return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), f.alias("f"))

    kept = F.filter(F.transform(f"_{kind}", scored), lambda s: sum((as_column(t, s["f"]) for t in trees), F.lit(0.0)) >= limit)
    return F.transform(kept, lambda s: F.struct(s["start"], s["rank"], s["kind"], s["end"]))


def _spanned(docs: DataFrame, text: str) -> DataFrame:
    """(row, body, base, spans): each row of ``docs`` as one struct, so that no column of the caller meets a helper's
    name; its text, null as empty; and the sorted arrays of (start, rank, kind, end).

    An added span goes only if another span covers all of it, so what the spans cover together stays the same. In order
    of start, longest first, that is so exactly if some span before it ends as late: one pass over the spans."""
    trees, limits = _model(docs.sparkSession)
    found = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    found = with_base_spans(found, "body", "base")
    names = []
    for rank, (kind, pattern) in enumerate(EXTRA.items(), len(BASE_KINDS)):
        found = _search(found, "body", F.col("body").rlike(_EXTRA_NEEDS[kind]), pattern, f"_{kind}")
        found = found.withColumn(f"_{kind}", _weighed(rank, kind, trees[kind], limits[kind]))
        names.append(f"_{kind}")
    longest_first = lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["rank"].alias("rank"), s["kind"].alias("kind"))
    found = found.withColumn("_all", F.array_sort(F.transform(F.concat("base", *names), longest_first)))
    found = found.withColumn("_far", running(F.transform("_all", lambda s: -s["back"]), F.lit(0).cast("long"), F.greatest))
    # zipped, not looked up by place: an outer column named once in a lambda would be computed for each element
    beside = F.slice(F.zip_with("_all", "_far", lambda s, far: F.struct(s.alias("s"), far.alias("far"))), F.lit(1), F.size("_all"))
    kept = F.filter(beside, lambda x: (x["s"]["rank"] < len(BASE_KINDS)) | (-x["s"]["back"] > x["far"]))
    spans = F.transform(kept, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["rank"].alias("rank"), x["s"]["kind"].alias("kind"), (-x["s"]["back"]).alias("end")))
    return found.select("row", "body", "base", F.array_sort(spans).alias("spans"))


def written_out(spans: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind as listed."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, one row a document.

    Null and empty texts have no spans; null and repeated ids pass through; other columns are not read; an empty
    table gives no rows; no shuffle."""
    found = _spanned(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", *map(count, BASE_KINDS), F.sha2(written_out(F.col("base")), 256).alias("base_sha256"), written_out(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; spans that overlap are replaced as one,
    by the kind that begins first.

    Every other column stays as it is, whatever its name; columns keep their order. Null texts stay null, empty ones
    empty; repeated rows are rows each; an empty table gives no rows; no shuffle."""
    found = _spanned(docs, text)
    # how far the spans before each one reach: a span that begins there or later begins a new stretch
    found = found.withColumn("_far", running(F.transform("spans", lambda s: s["end"]), F.lit(0).cast("long"), F.greatest))
    placed = F.slice(F.zip_with("spans", "_far", lambda s, far: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), far.alias("far"))), F.lit(1), F.size("spans"))
    found = found.withColumn("_runs", F.filter(placed, lambda s: s["start"] >= s["far"]))
    gap = lambda r: F.substr(F.col("body"), (r["far"] + 1).cast("int"), (r["start"] - r["far"]).cast("int"))
    parts = F.transform("_runs", lambda r: F.concat(gap(r), F.lit("["), F.upper(r["kind"]), F.lit("]")))
    rest = F.substr(F.col("body"), (F.element_at("_far", -1) + 1).cast("int"))
    clean = F.when(F.size("_runs") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("row")[text].cast("string"))
    return found.select(*[clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
