"""Surrogates for personal data: keyed, of the same type and form, distinct and the same everywhere.

Detected: e-mail addresses, telephone numbers, card and account numbers (13 to
19 digits), IPv4 addresses, and names after a form of address, with every other
mention of those people in the same text.  An entity is its type and its
canonical form (digits only, lower case), so one telephone number written in
two ways is one entity and gets one surrogate, written in the form of each
occurrence.

A person of a text is the longest form of the name; a shorter form (a part of
it, or its parts under another form of address that does not contradict) is the
nearest such person before it, else the first after it, and gets the same parts
of the surrogate.  Mentions without a form of address are found too: several
parts in a row always, a single part if it has three letters or more and its
small form is no word of the text ("Long" stays where "long" occurs).  The gender is what any
mention in the text tells.  Across texts people are the same if their longest
form and gender are.

A surrogate is made from a keyed hash (HMAC-SHA-256) of the entity: digits
become digits and letters become letters of the same script and case; a card
number keeps whether its check digit is right; a name keeps its gender and
script and number of parts.  Lengths (but for late attempts) and separators stay.

Collision checks run over the distinct entities of the corpus: entities that
share a surrogate, or whose surrogate is an entity of the corpus, are made
anew with the next attempt, all but the smallest of each group, until none is
left; where a form has too few values, later attempts are longer.  Only entities with an attempt other than 0 have to be told to the pass
that rewrites texts; up to ``BROADCAST_ROWS`` of them are broadcast, more are
joined to the documents that hold them.

No telephone numbers are dates, ranges of years, and amounts in groups of
three (one or two digits first, or beside a currency).

Defined results: a null text stays null, an empty text empty; overlapping
finds keep the first in the order e-mail, address, card, telephone, name;
the counts of kinds get a further ``_`` where the table has such a column;
repeated rows get equal results; an empty table gives no rows; all further
columns stay as they are.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.batches import slices
from pagegauge.llm.store import fresh, settled

KINDS = ("email", "ip", "card", "phone", "name")
BROADCAST_ROWS = 100_000
#: From this attempt on a surrogate of an e-mail address, telephone number or name is longer by one more character each time.
WIDER = 8

#: Forms of address by gender, and given names by gender and script.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "госпожа"),
    "n": ("Dr", "Prof", "Mx"),
}
GIVEN = {
    ("m", "LATIN"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Leon", "Marco", "Nils", "Oscar"),
    ("f", "LATIN"): ("Anna", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irina", "Laura", "Maria", "Nora"),
    ("n", "LATIN"): ("Alex", "Andrea", "Charlie", "Jamie", "Kim", "Luca", "Noa", "Robin", "Sam", "Sasha", "Toni", "Vanja"),
    ("m", "CYRILLIC"): ("Антон", "Борис", "Виктор", "Иван", "Николай", "Павел", "Сергей", "Фёдор"),
    ("f", "CYRILLIC"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Татьяна"),
    ("n", "CYRILLIC"): ("Женя", "Саша", "Слава", "Шура"),
}
_ALPHABETS = {
    "LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзиклмнопрстуфхцчшэюя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω",
}
_VOWELS = {"LATIN": "aeiou", "CYRILLIC": "аеиоу", "GREEK": "αεηιου"}

_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
_CAPITAL = "[^\\W\\d_]"
PATTERNS = {
    "email": re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)", re.A),
    "card": re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)", re.A),
    "name": re.compile(rf"(?<!\w)(?:{_TITLE})\.?\s+((?=[^\W\d_a-zà-ÿа-я]){_CAPITAL}+(?:[ -](?=[^\W\d_a-zà-ÿа-я]){_CAPITAL}+){{0,2}})"),
}
#: Forms of telephone numbers: with +; after a national or international 0; with an area in brackets; 3-3-4 and 3-4-4;
#: 3-4; three and more short groups.  None begins or ends inside a longer run of digits.
_SEP, _START, _END = r"[ \u00a0./-]", r"(?<![\w.+])(?<!\d[/-])", r"(?!\w|[.,/-]\d)"
PHONES = [re.compile(rf"{_START}(?:{form}){_END}", re.A) for form in (
    r"\+\d[\d \u00a0()./-]{5,20}\d",
    rf"(?:0(?!00)\d{{1,5}}|\(0(?!00)\d{{1,5}}\))(?:{_SEP}{{1,3}}(?:\(0\){_SEP}?)?\d{{2,8}}){{1,6}}", r"0(?!00)\d{8,14}",
    rf"(?:\d{{1,3}}{_SEP})?\(\d{{2,5}}\){_SEP}?\d{{2,8}}(?:{_SEP}\d{{2,4}}){{0,4}}",
    rf"(?:\d{{1,3}}{_SEP})?\d{{3}}{_SEP}\d{{3,4}}{_SEP}\d{{4}}", r"\d{3}-\d{4}", rf"\d{{2,4}}(?:{_SEP}\d{{2,4}}){{2,6}}")]
_YEAR, _MONTH, _DAY = r"(?:1[89]|20)\d\d", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])"
_DATE = re.compile(
    rf"(?<![\d+])(?<!\d[./-])(?:{_YEAR}([./-]){_MONTH}\1{_DAY}|{_DAY}([./-]){_MONTH}\2{_YEAR}|"
    rf"{_MONTH}([./-]){_DAY}\3{_YEAR})(?!\d|[./-]\d)", re.A)
#: Amounts in groups of three and ranges of years, with no further group of digits beside them.
_GROUPS, _CURRENCY = r"([ \u00a0.])\d{{3}}(?:\{0}\d{{3}})*(?:,\d{{1,2}})?", r"(?:[€$£¥₽%]|(?:EUR|USD|GBP|CHF|JPY|RUB|Euro|Dollar)\b)"
_ALONE, _NO_MORE = r"(?<![\d+.,/-])(?<![\d)][ \u00a0])", r"(?!\w|[ \u00a0./-]\d)"
_AMOUNT = re.compile(
    rf"{_ALONE}[1-9]\d?{_GROUPS.format(1)}{_NO_MORE}|{_ALONE}[1-9]\d\d{_GROUPS.format(2)}(?=[ \u00a0]?{_CURRENCY})|"
    rf"{_CURRENCY}[ \u00a0]?[1-9]\d\d{_GROUPS.format(3)}{_NO_MORE}|"
    rf"{_ALONE}{_YEAR}(?:{_SEP}{{1,3}}{_YEAR})+{_NO_MORE}", re.A)
_DIGIT = re.compile(r"\d", re.A)
_WORD = re.compile(r"[^\W\d_]+")
#: Signs beside a word that is part of an address.
_IN_ADDRESS = re.compile(r"[@+/_]|\.\w")
#: Fewest letters of a single part of a name that is found without a form of address.
BARE_LETTERS = 3
_HAS_TITLE = re.compile(rf"(?<!\w)(?:{_TITLE})\.?\s")


def _parts(name: str) -> tuple[str, ...]:
    return tuple(re.split("[ -]", name))


def _runs(parts: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
    """All parts in a row of a name, itself included."""
    for size in range(1, len(parts) + 1):
        for k in range(len(parts) - size + 1):
            yield parts[k:k + size]


def people(text: str) -> list[tuple[int, int, str, str]]:
    """Spans of names, each under the gender and the longest form of its person."""
    titled = []
    for m in PATTERNS["name"].finditer(text):
        title = text[m.start():m.start(1)].strip().rstrip(".")
        gender = next(g for g, titles in TITLES.items() if title in titles)
        titled.append((m.start(1), m.end(1), gender, m[1].lower()))
    # Mentions by the runs of parts they hold, in order of position.
    holders: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for k, (start, _, _, name) in enumerate(titled):
        for run in set(_runs(_parts(name))):
            holders.setdefault(run, []).append((start, k))

    def nearest(found: list[tuple[int, int]], at: int) -> int:
        place = bisect_left(found, (at,))
        return found[max(place - 1, 0)][1]

    # Mentions that hold a shorter form, by what its gender allows.
    longer: dict[tuple[tuple[str, ...], str], list[tuple[int, int]]] = {}
    for run, found in holders.items():
        more = [(at, k) for at, k in found if len(_parts(titled[k][3])) > len(run)]
        for gender in "mfn" if more else "":
            fitting = more if gender == "n" else [(at, k) for at, k in more if titled[k][2] in (gender, "n")]
            if fitting:
                longer[run, gender] = fitting
    root = list(range(len(titled)))
    for k in sorted(root, key=lambda k: -len(_parts(titled[k][3]))):
        found = longer.get((_parts(titled[k][3]), titled[k][2]))
        if found:
            root[k] = root[nearest(found, titled[k][0])]
    genders: dict[str, set[str]] = {}
    for k, (_, _, gender, _) in enumerate(titled):
        genders.setdefault(titled[root[k]][3], set()).add(gender)

    def form(k: int) -> str:
        _, _, gender, name = titled[root[k]]
        told = genders[name] - {"n"}
        return f"{next(iter(told)) if gender == 'n' and len(told) == 1 else gender}:{name}"

    spans = [(start, end, "name", form(k)) for k, (start, end, _, _) in enumerate(titled)]
    return spans + [(start, end, "name", form(nearest(holders[run], start))) for start, end, run in _bare(text, holders)]


def _bare(text: str, known: dict) -> Iterator[tuple[int, int, tuple[str, ...]]]:
    """Places where parts of known names are written with capitals, the longest run at each place."""
    single = {run[0] for run in known if len(run) == 1}
    words, ordinary = [], set()
    for m in _WORD.finditer(text):
        low = m[0].lower()
        if low in single:
            if m[0][0].isupper():
                words.append((m.start(), m.end(), low))
            elif not _IN_ADDRESS.search(text, max(m.start() - 1, 0), m.end() + 2):
                ordinary.add(low)
    k = 0
    while k < len(words):
        size = 1
        while size < 3 and k + size < len(words) and words[k + size][0] == words[k + size - 1][1] + 1 \
                and text[words[k + size - 1][1]] in " -":
            size += 1
        runs = (tuple(w[2] for w in words[k:k + n]) for n in range(size, 0, -1))
        run = next(r for r in runs if r in known)
        if len(run) > 1 or (len(run[0]) >= BARE_LETTERS and run[0] not in ordinary):
            yield words[k][0], words[k + len(run) - 1][1], run
        k += len(run)


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form), sorted and without overlap."""
    found: list[tuple[int, int, str, str]] = []
    digits = _DIGIT.search(text) is not None
    if "@" in text:
        found += [(m.start(), m.end(), "email", m[0].lower()) for m in PATTERNS["email"].finditer(text)]
    if digits:
        found += [(m.start(), m.end(), "ip", ".".join(str(int(p)) for p in m[0].split(".")))
                  for m in PATTERNS["ip"].finditer(text)]
        # Dates, ranges of years and amounts are no part of a number.
        plain = text
        for pattern in (_DATE, _AMOUNT):
            plain = pattern.sub(lambda m: "|" * len(m[0]), plain)
        found += [(m.start(), m.end(), "card", re.sub(r"\D", "", m[0])) for m in PATTERNS["card"].finditer(plain)]
        for pattern in PHONES:
            found += [(m.start(), m.end(), "phone", re.sub(r"\D", "", m[0])) for m in pattern.finditer(plain)
                      if 7 <= sum(c.isdigit() for c in m[0]) <= 15]
    if _HAS_TITLE.search(text):
        found += people(text)
    order = {k: i for i, k in enumerate(KINDS)}
    taken: list[tuple[int, int, str, str]] = []
    for f in sorted(found, key=lambda f: (order[f[2]], f[0], -f[1])):
        k = bisect_left(taken, (f[0],))
        if (k == 0 or taken[k - 1][1] <= f[0]) and (k == len(taken) or taken[k][0] >= f[1]):
            taken.insert(k, f)
    return taken


class Surrogates:
    """Canonical surrogates of canonical entities under a key."""

    def __init__(self, key: bytes):
        self.key = key

    def _stream(self, kind: str, form: str, attempt: int) -> Iterator[int]:
        block = 0
        while True:
            yield from hmac.digest(self.key, f"{kind}\0{form}\0{attempt}\0{block}".encode(), hashlib.sha256)
            block += 1

    def of(self, kind: str, form: str, attempt: int = 0) -> str:
        draw = self._stream(kind, form, attempt)
        made, more = getattr(self, f"_{kind}")(form, draw), max(0, attempt - WIDER + 1)
        if not more or kind in ("ip", "card"):  # of these there are enough, and their length is fixed
            return made
        if kind == "email":
            local, _, domain = made.partition("@")
            return f"{local}{self._like('a' * more, draw)}@{domain}"
        return made + self._like(("0" if kind == "phone" else made[-1]) * more, draw)

    def _email(self, form: str, draw: Iterator[int]) -> str:
        local, _, domain = form.partition("@")
        # One domain always becomes the same other domain; its last label stays.
        labels = domain.split(".")
        own = self._stream("domain", domain, 0)
        domain = ".".join([*(self._like(label, own) for label in labels[:-1]), labels[-1]])
        return f"{self._like(local, draw)}@{domain}"

    def _ip(self, form: str, draw: Iterator[int]) -> str:
        return ".".join(str(1 + (next(draw) * 256 + next(draw)) % 254) for _ in form.split("."))

    def _card(self, form: str, draw: Iterator[int]) -> str:
        digits = [next(draw) * 256 + next(draw) for _ in form[:-1]]
        body = str(1 + digits[0] % 9) + "".join(str(d % 10) for d in digits[1:])
        right = check_digit(body)
        if check_digit(form[:-1]) == form[-1]:
            return body + right
        return body + str((int(right) + 1 + (next(draw) % 9)) % 10)

    def _phone(self, form: str, draw: Iterator[int]) -> str:
        # The first digits (country or area) and the length stay a plausible number.
        kept = 1 if len(form) > 10 else 0
        return form[:kept] + "".join(str((next(draw) * 256 + next(draw)) % 10) for _ in form[kept:])

    def _name(self, form: str, draw: Iterator[int]) -> str:
        gender, _, name = form.partition(":")
        parts = re.split(r"([ -])", name)
        script = script_of(name)
        out = []
        for k, part in enumerate(parts):
            given = GIVEN.get((gender, script))
            if k % 2:
                out.append(part)
            elif k == 0 and len(parts) > 1 and given:
                out.append(given[(next(draw) * 256 + next(draw)) % len(given)].lower())
            else:
                out.append(self._family(script, draw))
        return f"{gender}:" + "".join(out)

    @staticmethod
    def _family(script: str, draw: Iterator[int]) -> str:
        letters, vowels = _ALPHABETS.get(script, _ALPHABETS["LATIN"]), _VOWELS.get(script, _VOWELS["LATIN"])
        consonants = [c for c in letters if c not in vowels]
        return "".join(
            consonants[next(draw) % len(consonants)] + vowels[next(draw) % len(vowels)] for _ in range(4)
        ) + consonants[next(draw) % len(consonants)]

    @staticmethod
    def _like(text: str, draw: Iterator[int]) -> str:
        out = []
        for c in text:
            if c.isdigit():
                out.append(str((next(draw) * 256 + next(draw)) % 10))
            elif c.isalpha():
                letters = _ALPHABETS.get(script_of(c), _ALPHABETS["LATIN"])
                out.append(letters[(next(draw) * 256 + next(draw)) % len(letters)])
            else:
                out.append(c)
        return "".join(out)


def check_digit(body: str) -> str:
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def script_of(text: str) -> str:
    letter = next((c for c in text if c.isalpha()), "a")
    return unicodedata.name(letter, "LATIN").split(" ")[0]


def same_parts(form: str, surrogate: str, occurrence: str) -> str:
    """The parts of a person's surrogate that stand where those of the occurrence stand in the person's name."""
    whole, wanted = _parts(form.partition(":")[2]), _parts(occurrence.lower())
    at = next(k for k in range(len(whole)) if whole[k:k + len(wanted)] == wanted)
    made = _parts(surrogate)[at:at + len(wanted)]
    return "".join(p for pair in zip(made, [*re.findall("[ -]", occurrence), ""], strict=True) for p in pair)


def written_like(kind: str, surrogate: str, occurrence: str, form: str | None = None) -> str:
    """The canonical surrogate in the form of one occurrence; ``form`` is the entity it mentions, perhaps in part."""
    if kind in ("card", "phone"):
        digits = iter(surrogate)
        return "".join([*(next(digits) if c.isdigit() else c for c in occurrence), *digits])
    if kind == "ip":
        return surrogate
    plain = surrogate.partition(":")[2] if kind == "name" else surrogate
    if kind == "name" and form is not None:
        plain = same_parts(form, plain, occurrence)
    if occurrence.isupper():
        return plain.upper()
    if kind == "name":
        return re.sub(r"[^\W\d_]+", lambda m: m[0].capitalize(), plain)
    if len(plain) != len(occurrence):
        return plain
    return "".join(p.upper() if o.isupper() else p for p, o in zip(plain, occurrence, strict=True))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, form): the distinct entities of all texts."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: set[tuple[str, str]] = set()
            for part in slices(batch, "text"):
                for t in part.column("text").to_pylist():
                    own.update((kind, form) for _, _, kind, form in detect(t) if t)
            kinds, forms = zip(*sorted(own), strict=True) if own else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(forms, pa.string())], ["kind", "form"])

    texts = docs.select(F.col(text).cast("string").alias("text")).where("text is not null")
    return texts.mapInArrow(found, "kind string, form string").distinct()


def exceptions(known: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, attempt): entities whose first surrogate would collide, with an attempt that does not."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(key)
        for batch in batches:
            made = [maker.of(k, f, a) for k, f, a in zip(
                *(batch.column(c).to_pylist() for c in ("kind", "form", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())],
                                             ["kind", "form", "attempt", "surrogate"])

    def made(rows: DataFrame, name: str) -> DataFrame:
        return settled(rows.mapInArrow(make, "kind string, form string, attempt int, surrogate string"), name)

    current = made(known.withColumn("attempt", F.lit(0)), "pii-surrogates")
    originals = known.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("_real"))
    while True:  # from attempt WIDER on surrogates grow, so that there are always enough of them
        sizes = current.groupBy("kind", "surrogate").agg(F.min("form").alias("_first"), F.count("*").alias("_n"))
        judged = current.join(sizes.where("_n > 1"), ["kind", "surrogate"], "left").join(
            originals, ["kind", "surrogate"], "left")
        again = judged.where("_real or form != _first").select("kind", "form", "attempt")
        if again.isEmpty():
            return current.where("attempt > 0").select("kind", "form", "attempt")
        fixed = current.join(again.select("kind", "form"), ["kind", "form"], "left_anti").select(current.columns)
        new = made(again.withColumn("attempt", F.col("attempt") + 1), "pii-again")
        current = settled(fixed.union(new), "pii-surrogates")


def pseudonymized(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """All columns of the documents, surrogates in the text, and the number of entities of each kind."""
    odd = exceptions(settled(entities(docs, text), "pii-entities"), key)
    odd = settled(odd, "pii-exceptions")
    kept = list(docs.columns)
    counts = [fresh(docs, f"n_{k}") for k in KINDS]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept),
                        *(f"`{c}` long" for c in counts)])
    known = None
    if odd.count() <= BROADCAST_ROWS:
        known = docs.sparkSession.sparkContext.broadcast({(r.kind, r.form): r.attempt for r in odd.collect()})
        rows, extra = docs, None
    else:
        extra = fresh(docs, "_attempts")
        rows = _with_attempts(docs, odd, text, extra)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(key)
        at = kept.index(text)
        for batch in batches:
            for part in slices(batch, text):
                own = part.column(extra).to_pylist() if extra else None
                texts, numbers = [], []
                for k, t in enumerate(part.column(text).to_pylist()):
                    attempts = known.value if known else {(a["kind"], a["form"]): a["attempt"] for a in own[k] or ()}
                    done, found = _rewritten(t, maker, attempts)
                    texts.append(done)
                    numbers.append([sum(f[2] == kind for f in found) for kind in KINDS])
                columns = [part.column(c) for c in kept]
                columns[at] = pa.array(texts, pa.string())
                columns += [pa.array(n, pa.int64()) for n in (zip(*numbers, strict=True) if numbers else [[]] * len(KINDS))]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *counts])

    return rows.mapInArrow(rewrite, schema)


def _rewritten(text: str | None, maker: Surrogates, attempts: dict) -> tuple[str | None, list]:
    found = detect(text) if text else []
    out, at = [], 0
    for start, end, kind, form in found:
        surrogate = maker.of(kind, form, attempts.get((kind, form), 0))
        out += [text[at:start], written_like(kind, surrogate, text[start:end], form)]
        at = end
    return ("".join([*out, text[at:]]) if found else text), found


def _with_attempts(docs: DataFrame, odd: DataFrame, text: str, name: str) -> DataFrame:
    """The documents with the attempts of the entities they hold, joined by a hash of the text.

    Equal texts hold equal entities, so each distinct text is listed once.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(h, kind, form) for h, t in zip(
                    part.column("_h").to_pylist(), part.column("text").to_pylist(), strict=True)
                    for kind, form in sorted({(f[2], f[3]) for f in detect(t)})]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["_h", "kind", "form"])

    by = fresh(docs, "_h")
    digest = F.sha2(F.col(text).cast("string"), 256)
    texts = docs.select(digest.alias("_h"), F.col(text).cast("string").alias("text")).where("text is not null")
    held = texts.mapInArrow(listed, "_h string, kind string, form string").distinct()
    attempts = held.join(odd, ["kind", "form"]).groupBy(F.col("_h").alias(by)).agg(
        F.collect_list(F.struct("kind", "form", "attempt")).alias(name))
    return docs.withColumn(by, digest).join(attempts, by, "left").drop(by)
