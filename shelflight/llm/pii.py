"""Keyed surrogates for personal data, in DataFrame functions only.

Entities are found by one alternation of bounded patterns. Every entity has a
canonical form, so that the spellings of one phone or card number share one
surrogate (coreference), and a surrogate is drawn from a keyed hash of kind,
canonical form and attempt. Surrogates keep the kind's format: digits stay
digits, letters stay letters of their script and case, card and account numbers
keep their scheme or country and the truth of their check digits, secrets keep
their name and prefix.

A person is found by a title, and then by the full name anywhere in the same
text. Behind a title come up to two given names and initials, particles (von,
de la), and a family name; names on both sides of a hyphen are names of their
own. Each name has a surrogate of its own, so "Dr. Anna Maria Smith", "Mrs.
Smith" and "Anna Smith" agree, whatever the title; particles stay, and an initial
becomes another. The given name keeps
its script and gender: that of a title the person has in the text, else what the
name's ending says; where texts disagree about a person, what most entities of
the corpus say. A name without any title in its text is not found, nor one in a
script without capitals. One word behind a title is taken for a family name.

Distinctness is checked over all entities of the corpus: a surrogate that two
entities share, or that is itself an entity of the corpus, is drawn again for
all but the first. Surrogates of attempt 0 need no lookup, they are worked out
in place, so replacing is one pass over the text without a shuffle; only what
was drawn again, and people whose gender was settled by the corpus, are joined
in by document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelflight.llm.common import join_per_key, materialise

#: Titles by gender, and what may stand between the names of a person (fixed values). Latin titles also stand in capitals.
_MALE_TITLES = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Signor")
_FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señorita", "Srta", "Señora", "Sra", "Signora", "Signorina")
_OTHER_TITLES = ("Professor", "Doctor", "Doktor", "Docteur", "Dr", "Prof")
PARTICLES = "von van vom zu zur zum der den de del della di da do dos du la le el al bin ibn ben ter ten af av".split()


def _either_case(titles: tuple[str, ...]) -> str:
    return "|".join(f"{t}|{t.upper()}" for t in titles)


# a French M stands with its point only, which a lone capital also is: two names follow it, or a family name
_MALE = _either_case(_MALE_TITLES) + r"|M(?=\. \p{Lu}\p{Ll})|господин|г-н|Κύριος|κύριος|κ"
_FEMALE = _either_case(_FEMALE_TITLES) + "|госпожа|г-жа|Κυρία|κυρία|κα"
_EITHER = _either_case(_OTHER_TITLES) + "|Δρ|д-р"
_TITLE = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{_FEMALE}|{_MALE}|{_EITHER})(?:\. ?|[ ])\n?)+"
_WORD = r"(?:(?:al|el)-)?\p{Lu}[\p{L}'’-]{1,40}"
_INITIAL = r"\p{Lu}\."
#: Up to two names or initials, each alone or behind another initial, particles, and the last name.
_NAME = rf"(?:{_INITIAL}[ \n]?){{0,3}}(?:{_WORD} (?:{_INITIAL} ?){{0,2}}){{0,2}}(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_WORD}"
#: Beginnings of access tokens (fixed values).
_TOKEN = r"(?:github_pat_|gh[opusr]_|glpat-|xox[abprs]-|sk_live_|sk_test_|sk-|AIza)"
_SECRET_KEY = r"(?i:password|passwd|pwd|secret|api_key|apikey|token) ?[=:] ?[\"']?"

#: First four digits of cards of the 2 series.
_TWO = r"(?:222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720)"

#: kind: pattern. Repetitions are bounded or of one class of characters, so long texts need no deep recursion.
PATTERNS = {
    "secret": rf"(?<![A-Za-z0-9]){_SECRET_KEY}[A-Za-z0-9_+/.-]{{8,}}+",
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}@[\p{L}0-9-]{1,63}(?:\.[\p{L}0-9-]{1,63}){1,8}",
    "key": r"(?<![A-Za-z0-9])(?:A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])|" + _TOKEN + r"[A-Za-z0-9_-]{16,}+)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])[a-z]{2}\d{2}(?: (?=[a-z]{0,3}\d)[a-z0-9]{4}){2,7}(?: [a-z0-9]{1,3}(?![A-Za-z0-9]))?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+.])(?:(?:\+|00(?=[1-9]))\d{1,3}[ .-]?(?:\(0\) ?)?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}"
    r"|(?<!-)(?:\(?0[1-9]\d{1,4}\)?[ /-]{1,3}(?:\d{5,8}|\d{3,4}[ -]?\d{3,5}|\d{2,4}(?:[ -]\d{2,4}){2,4})|0[1-9](?:[ .-]\d{2}){4}))(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)",
    "ipv6": r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "card": rf"(?<![\w-])(?:[3-6]\d{{12,18}}|{_TWO}\d{{12}}|(?:[3-6]\d{{3}}|{_TWO})(?:[ .-]\d{{4}}){{3}}|3\d{{3}}[ .-]\d{{6}}[ .-]\d{{5}})(?![\w-])",
    "name": _TITLE + _NAME,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text needs to hold before the patterns are tried.
MAYBE = rf"[0-9@]|A[KS]IA|{_TOKEN}|{_SECRET_KEY}|{_TITLE}"

#: By script: the letters that draw letters, syllables of names, endings of men's and women's given names (fixed values).
SCRIPTS = {
    "latin": ("abcdefghijklmnopqrstuvwxyz", "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no pa po ra re ri ro sa se so ta te to va ve",
              "n l s k rd", "na la sa ria lia"),
    "cyrillic": ("абвгдежзиклмнопрстуфхцчшэюя", "ба бе бо да де ди до фа фе га го ка ке ко ла ле ли ло ма ме ми мо на не но па по ра ре ро са се со та то ва ве",
                 "н л с к р", "на ла са рия лия"),
    "greek": ("αβγδεζηθικλμνξοπρστυφχψω", "βα βε βο δα δε δο φα φε γα γο κα κε κο λα λε λο μα με μο να νε νο πα πο ρα ρε ρο σα σε σο τα το",
              "νος λος ρης κης μος", "να λα νη ρα μη"),
    "armenian": ("աբգդեզէթժիլխծկհձղճմյնշչպջռսվտրցփքֆ", "բա բե բո դա դե դո գա գո կա կե կո լա լե լո մա մե մո նա նե նո պա պո ռա ռե սա սե սո տա տո",
                 "ն լ կ մ պ", "նա լա կա մա պա"),
}
#: Endings that mark a given name as a woman's where no title tells (fixed values).
_SHE = r"[aeiаяαηίάήաե]$"
MAX_ATTEMPTS = 32


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entities(text: Column) -> Column:
    """Entities of a text in order of place, as they stand, but for full names without a title."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def kind_of(entity: Column) -> Column:
    """The kind whose pattern an entity matches as a whole."""
    found = F.lit("name")
    for kind, pattern in reversed([(k, p) for k, p in PATTERNS.items() if k != "name"]):
        found = F.when(entity.rlike(rf"\A(?:{pattern})\z"), F.lit(kind)).otherwise(found)
    return found


def _digits(entity: Column) -> Column:
    return F.regexp_replace(entity, r"\D+", "")


def prefix_of(entity: Column, kind: Column) -> Column:
    """What stays before the part that is replaced: a secret's name, a key's scheme, a person's title."""
    return (
        F.when(kind == "secret", F.regexp_extract(entity, _SECRET_KEY, 0))
        .when(kind == "key", F.regexp_extract(entity, rf"^(?:A[KS]IA|{_TOKEN})", 0))
        .when(kind == "iban", F.substring(entity, 1, 2))
        .when(kind == "name", F.regexp_extract(entity, _TITLE, 0))
        .otherwise(F.lit(""))
    )


def _body(entity: Column, kind: Column) -> Column:
    return F.substring(entity, F.length(prefix_of(entity, kind)) + F.lit(1), F.length(entity))


def _gender(entity: Column) -> Column:
    """m or f by the title of an entity; n where it has none or one for both."""
    return (
        F.when(entity.rlike(rf"^(?:{_FEMALE})\b"), F.lit("f"))
        .when(entity.rlike(rf"^(?:{_MALE})\b"), F.lit("m"))
        .otherwise(F.lit("n"))
    )


def person_of(entity: Column) -> Column:
    """All names of a name entity in lower case, a blank between; the family name alone of one word."""
    spaced = F.regexp_replace(_body(entity, F.lit("name")), r"\.(?=[^ \n])", ". ")
    return F.lower(F.regexp_replace(spaced, r"[ \n]+", " "))


def _family(person: Column) -> Column:
    return F.substring_index(person, " ", -1)


def _given(person: Column) -> Column:
    """The first of several names that is no initial and no particle; null for none."""
    names = F.filter(F.split(person, " "), lambda w: ~w.endswith(".") & ~w.isin(*PARTICLES))
    return F.when(F.size(names) > 1, F.get(names, F.lit(0)))


def short_person(person: Column) -> Column:
    """The first and the last name of a person of three words or more; null of fewer."""
    first = _given(person)
    return F.when((F.size(F.split(person, " ")) > 2) & first.isNotNull(), F.concat(first, F.lit(" "), _family(person)))


def name_parts(person: Column, gender: Column) -> Column:
    """(kind, canonical) of what a person's names are drawn from, in order: given-m or given-f, family, initial or particle.

    Names with a hyphen have a part for each side.
    """
    words = F.split(person, " ")

    def of(word: Column, at: Column) -> Column:
        own = F.when(word.isin(*PARTICLES), F.lit("particle")).when(at == F.size(words) - 1, F.lit("family"))
        own = own.when(word.endswith("."), F.lit("initial")).otherwise(F.concat(F.lit("given-"), gender))
        sides = F.split(word, "-")
        return F.transform(sides, lambda s: F.named_struct(F.lit("kind"), F.when(s.isin("al", "el"), F.lit("particle")).otherwise(own), F.lit("canonical"), s))

    return F.flatten(F.transform(words, of))


#: Parts of names that are checked for distinctness; initials are too few for it, particles stay.
_DRAWN_PARTS = ("given-m", "given-f", "family")


def guessed_gender(given: Column) -> Column:
    """m or f by a given name's ending."""
    return F.when(given.rlike(_SHE), F.lit("f")).otherwise(F.lit("m"))


def script_of(text: Column) -> Column:
    return (
        F.when(text.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic"))
        .when(text.rlike(r"\p{IsGreek}"), F.lit("greek"))
        .when(text.rlike(r"\p{IsArmenian}"), F.lit("armenian"))
        .otherwise(F.lit("latin"))
    )


def canonical_of(entity: Column, kind: Column) -> Column:
    """One form for all spellings of an entity; of a name the person."""
    body = _body(entity, kind)
    return (
        F.when(kind.isin("card", "ssn"), _digits(entity))
        .when(kind == "phone", F.regexp_replace(_last(_digits(_without_trunk(entity)), 10), "^0(?!0)", ""))
        .when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind == "iban", F.upper(F.translate(entity, " ", "")))
        .when(kind == "name", person_of(entity))
        .otherwise(body)
    )


def _without_trunk(entity: Column) -> Column:
    """A phone number whose ``(0)``, which is dialled at home only, counts as no digit."""
    return F.replace(entity, F.lit("(0)"), F.lit("(\x02)"))


def _last(text: Column, n: int) -> Column:
    return F.substring(text, F.greatest(F.length(text) - F.lit(n - 1), F.lit(1)), F.lit(n))


def _byte(digest: Column, at: Column) -> Column:
    """The at-th byte of a 64-byte hexadecimal digest, going round."""
    return F.conv(F.substring(digest, F.pmod(at, F.lit(64)) * 2 + F.lit(1), F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str], number: Column) -> Column:
    options = F.array(*[F.lit(v) for v in values])
    return F.get(options, F.pmod(number, F.lit(len(values))))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit counting once."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + F.lit(1), F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of digits and capitals, A counting as 10."""

    def add(total: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        value = F.when(digit, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (total * F.when(digit, 10).otherwise(100) + value) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _by_script(script: Column, values: Callable[[str], Column]) -> Column:
    out = values("latin")
    for other in SCRIPTS:
        out = out if other == "latin" else F.when(script == other, values(other)).otherwise(out)
    return out


def _drawn_chars(body: Column, digest: Column, fixed_from: Column, hexadecimal: Column) -> Column:
    """``body`` with letters and digits before ``fixed_from`` drawn anew in their class and script."""

    def letter(c: Column, b: Column) -> Column:
        letters = F.when(c.rlike("[A-Za-z]"), F.lit(SCRIPTS["latin"][0])).otherwise(_by_script(script_of(c), lambda s: F.lit(SCRIPTS[s][0])))
        size = F.when(hexadecimal, 6).otherwise(F.length(letters))
        new = F.substring(letters, b % size + F.lit(1), F.lit(1))
        return F.when(c == F.lower(c), new).otherwise(F.upper(new))

    def draw(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        return (
            F.when(i >= fixed_from, c)
            .when(c.rlike("[0-9]"), (b % 10).cast("string"))
            .when(c.rlike(r"\p{L}"), letter(c, b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(body, ""), draw), "")


def surrogate_of(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The keyed surrogate of a canonical form, itself in canonical form.

    Parts of names have kinds of their own: given-m, given-f and family.
    """
    digest = F.sha2(F.concat_ws("\x01", F.lit(key), kind, attempt.cast("string"), canonical).cast("binary"), 512)
    return _let(digest, lambda d: _surrogate(kind, canonical, d, attempt))


def _name_part(kind: Column, canonical: Column, digest: Column, attempt: Column) -> Column:
    """Syllables of the name's script, longer with each attempt, and an ending by gender."""
    script = script_of(canonical)
    words = lambda at: _by_script(script, lambda s: F.array(*map(F.lit, SCRIPTS[s][at].split())))
    pick = lambda options, n: F.get(options, n % F.size(options))
    often = F.when(kind == "family", F.lit(4)).otherwise(F.lit(3)) + attempt
    drawn = _let(words(1), lambda w: F.array_join(F.transform(F.sequence(F.lit(1), often), lambda i: pick(w, _byte(digest, i))), ""))
    return F.concat(drawn, pick(F.when(kind == "given-f", words(3)).otherwise(words(2)), _byte(digest, F.lit(0))))


def _surrogate(kind: Column, canonical: Column, digest: Column, attempt: Column) -> Column:
    byte = lambda n: _byte(digest, F.lit(n))

    def number(r: Column) -> Column:
        """All digits drawn, the first from 2 for a phone, from 1 for others."""
        low = F.when(kind == "phone", 2).otherwise(1)
        return F.concat((low + byte(0) % 8).cast("string"), F.substring(r, F.lit(2), F.length(r)))

    def card(r: Column) -> Column:
        own = F.concat(F.substring(canonical, 1, 1), F.substring(r, F.lit(2), F.length(r) - F.lit(2)))
        check = F.pmod(F.lit(10) - _luhn_sum(F.concat(own, F.lit("0"))) % 10, F.lit(10))
        shift = F.when(_luhn_sum(canonical) % 10 == 0, F.lit(0)).otherwise(F.lit(1) + byte(63) % 9)
        return F.concat(own, F.pmod(check + shift, F.lit(10)).cast("string"))

    def account(r: Column) -> Column:
        country, own = F.substring(canonical, 1, 2), F.substring(r, F.lit(5), F.length(r))
        right = _mod97(F.concat(F.substring(canonical, F.lit(5), F.length(canonical)), F.substring(canonical, 1, 4))) == 1
        check = F.lit(98) - _mod97(F.concat(own, country, F.lit("00")))
        shift = F.when(right, F.lit(0)).otherwise(F.lit(1) + byte(63) % 95)
        return F.concat(country, F.lpad((F.pmod(check - 2 + shift, F.lit(97)) + 2).cast("string"), 2, "0"), own)

    ip = F.concat_ws(".", (F.lit(1) + byte(0) % 223).cast("string"), *[byte(n).cast("string") for n in (1, 2, 3)])
    # an address keeps its last label; hexadecimal secrets stay hexadecimal
    fixed = F.when(kind == "email", F.length(canonical) - F.length(F.substring_index(canonical, ".", -1))).otherwise(F.lit(1 << 30))
    hexadecimal = (kind == "ipv6") | canonical.rlike(r"\A(?:[0-9a-f]+|[0-9A-F]+)\z")
    by_char = _let(
        _drawn_chars(canonical, digest, fixed, hexadecimal),
        lambda r: F.when(kind.isin("phone", "ssn"), number(r)).when(kind == "card", card(r)).when(kind == "iban", account(r)).otherwise(r),
    )
    alone = F.concat(F.substring(_drawn_chars(F.substring(canonical, 1, 1), digest, F.lit(9), F.lit(False)), 1, 1), F.lit("."))
    return (
        F.when(kind == "ip", ip)
        .when(kind == "initial", alone)
        .when(kind.isin("given-m", "given-f", "family"), _name_part(kind, canonical, digest, attempt))
        .otherwise(by_char)
    )


def render(entity: Column, kind: Column, surrogate: Column) -> Column:
    """A canonical surrogate in the spelling of an entity: its punctuation, case, prefix and country code."""
    start = F.struct(F.lit("").alias("done"), F.lit(1).alias("at"))

    def filled_in(filled: Column, place: str) -> Column:
        return filled_in_text(entity, filled, place)

    def filled_in_text(entity: Column, filled: Column, place: str = "[0-9]") -> Column:
        """The entity with the characters of ``filled`` in turn where it has one of the class ``place``."""

        def fill(state: Column, c: Column) -> Column:
            taken = c.rlike(place)
            return F.struct(
                F.concat(state["done"], F.when(taken, F.substring(filled, state["at"], F.lit(1))).otherwise(c)).alias("done"),
                (state["at"] + taken.cast("int")).alias("at"),
            )

        return F.aggregate(F.split(entity, ""), start, fill, lambda s: s["done"])

    def letter(c: Column, i: Column) -> Column:
        new = F.substring(surrogate, i + F.lit(1), F.lit(1))
        return F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)

    def word(old: Column, new: Column) -> Column:
        """In capitals, with a capital, or as it is, by the name before."""
        small = F.when(old == F.lower(old), new).otherwise(F.initcap(new))
        return F.when((old == F.upper(old)) & (F.length(old) > 2), F.upper(new)).otherwise(small)

    def words(body: Column) -> Column:
        """The new names in the old ones' places, what stands between them kept."""
        old = F.regexp_extract_all(body, F.lit(r"[^ \n.-]+\.?"), F.lit(0))
        gaps = F.split(body, r"[^ \n.-]+\.?", -1)  # one more than names
        new = F.zip_with(old, F.split(surrogate, " "), word)
        return F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")

    whole = _digits(_without_trunk(entity))
    kept = F.length(whole) - F.length(surrogate)  # a country code or a 0 before the number
    filled = F.concat(F.substring(whole, F.lit(1), kept), surrogate)
    account = filled_in(surrogate, "[A-Za-z0-9]")
    return (
        F.when((kind == "phone") & entity.contains("(0)"), _let(filled, lambda f: F.replace(filled_in_text(_without_trunk(entity), f), F.lit("\x02"), F.lit("0"))))
        .when(kind.isin("phone", "card", "ssn"), _let(filled, lambda f: filled_in(f, "[0-9]")))
        .when(kind == "iban", F.when(entity == F.lower(entity), F.lower(account)).otherwise(account))
        .when(kind.isin("email", "ipv6"), F.array_join(F.transform(F.split(entity, ""), letter), ""))
        .when(kind == "name", F.concat(prefix_of(entity, kind), _let(_body(entity, kind), words)))
        .otherwise(F.concat(prefix_of(entity, kind), surrogate))
    )


# --- persons of a text -----------------------------------------------------------


def _titled(text: Column) -> Column:
    """(person, gender) of the full names behind a title in a text: what one text says of its people."""
    named = F.regexp_extract_all(text, F.lit(_TITLE + _NAME), F.lit(0))
    people = F.transform(named, lambda e: F.struct(person_of(e).alias("person"), _gender(e).alias("gender")))
    short = F.transform(people, lambda p: F.named_struct(F.lit("person"), short_person(p["person"]), F.lit("gender"), p["gender"]))
    return F.filter(F.concat(people, short), lambda p: p["person"].contains(" "))


def _full_names(text: Column) -> Column:
    """The full names behind a title in a text, as they stand, each once; of longer ones also the first and the last name."""
    bodies = F.transform(F.regexp_extract_all(text, F.lit(_TITLE + _NAME), F.lit(0)), lambda e: _body(e, F.lit("name")))
    full = F.filter(bodies, lambda b: b.contains(" "))
    short = F.transform(full, lambda b: F.when((F.size(F.split(b, " ")) > 2) & ~b.contains("."), F.concat(F.substring_index(b, " ", 1), F.lit(" "), F.substring_index(b, " ", -1))))
    # the longest first, so that none is cut by a part of its own
    found = F.array_distinct(F.concat(full, F.filter(short, lambda s: s.isNotNull() & s.rlike(r"^\p{Lu}"))))
    return F.transform(F.sort_array(F.transform(found, lambda n: F.struct((-F.length(n)).alias("size"), n.alias("name")))), lambda x: x["name"])


def pattern_of(names: Column) -> Column:
    """The alternation of all patterns and of the full names of a text."""
    quoted = F.array_join(F.transform(names, lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))), "|")
    own = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(names) > 0, own).otherwise(F.lit(ANY))


def gender_in(people: Column, person: Column) -> Column:
    """The gender of a person in a text: that of the first title that tells, else by the given name."""
    told = F.get(F.filter(people, lambda p: (p["person"] == person) & (p["gender"] != "n")), F.lit(0))["gender"]
    return F.coalesce(told, guessed_gender(_given(person)))


def _redrawn(found: DataFrame, key: str) -> DataFrame | None:
    """(kind, canonical, surrogate) of entities whose first surrogate was taken; None if there are none.

    ``found`` has the distinct (kind, canonical) of the whole corpus.
    """
    drawn = materialise(
        found.withColumn("attempt", F.lit(0)).withColumn(
            "surrogate", surrogate_of(F.col("kind"), F.col("canonical"), F.col("attempt"), key)
        ),
        "surrogates",
    )
    originals = found.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("original"))
    for attempt in range(1, MAX_ATTEMPTS + 1):
        checked = drawn.join(originals.hint("merge"), ["kind", "surrogate"], "left").selectExpr(
            "kind",
            "canonical",
            "attempt",
            "surrogate",
            """original is not null or row_number() over (
                 partition by kind, surrogate order by attempt, canonical) > 1 as taken""",
        )
        if not checked.where("taken").limit(1).count():
            break
        again = F.when(F.col("taken"), F.lit(attempt)).otherwise(F.col("attempt"))
        fresh = surrogate_of(F.col("kind"), F.col("canonical"), F.lit(attempt), key)
        drawn = materialise(
            checked.select(
                "kind",
                "canonical",
                again.alias("attempt"),
                F.when(F.col("taken"), fresh).otherwise(F.col("surrogate")).alias("surrogate"),
            ),
            "surrogates",
        )
    else:
        raise ValueError(f"entities still share surrogates after {MAX_ATTEMPTS} draws")
    return None if attempt == 1 else drawn.where("attempt > 0").select("kind", "canonical", "surrogate")


def _people(names: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(person, gender) of full names, and of those the people of whom texts disagree; None if there are none.

    ``names`` has distinct person, gender (as a text has it) and told (by a title).
    """
    votes = F.count_if(F.col("told") & (F.col("gender") == "f")) - F.count_if(F.col("told") & (F.col("gender") == "m"))
    seen = names.groupBy("person").agg(
        votes.alias("votes"), F.bool_or("told").alias("told"), F.min("gender").alias("least"), F.max("gender").alias("most")
    )
    by_votes = F.when(F.col("votes") > 0, F.lit("f")).when(F.col("votes") < 0, F.lit("m")).otherwise(guessed_gender(_given(F.col("person"))))
    settled = materialise(
        seen.select("person", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(by_votes).alias("gender"), (F.col("least") != F.col("most")).alias("open")),
        "people",
    )
    disputed = settled.where("open").select("person", "gender")
    return settled.select("person", "gender"), None if disputed.isEmpty() else disputed


def _replaced(text: Column, entities_: Column, pattern: Column, people: Column, key: str, table: Column | None) -> Column:
    """The text with every entity's surrogate in its place."""

    def known(kind: Column, canonical: Column, otherwise: Column) -> Column:
        if table is None:
            return otherwise
        return F.coalesce(F.try_element_at(table, F.concat_ws("\x01", kind, canonical)), otherwise)

    def parts(kind: Column, canonical: Column) -> Column:
        """What is drawn for an entity: (kind, canonical), for a person each name."""
        gender = known(F.lit("person"), canonical, gender_in(people, canonical))
        return F.when(kind == "name", _let(gender, lambda g: name_parts(canonical, g))).otherwise(
            F.array(F.named_struct(F.lit("kind"), kind, F.lit("canonical"), canonical))
        )

    def drawn(part: Column) -> Column:
        new = known(part["kind"], part["canonical"], surrogate_of(part["kind"], part["canonical"], F.lit(0), key))
        return F.when(part["kind"] == "particle", part["canonical"]).otherwise(new)

    def one(entity: Column) -> Column:
        def with_kind(kind: Column) -> Column:
            new = _let(canonical_of(entity, kind), lambda canonical: F.array_join(F.transform(parts(kind, canonical), drawn), " "))
            return _let(new, lambda n: render(entity, kind, n))

        return _let(kind_of(entity), with_kind)

    between = F.split(text, pattern, -1)
    # the text between entities is one longer than the entities
    return F.array_join(
        F.flatten(F.zip_with(between, F.transform(entities_, one), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""
    )


def replace_entities(df: DataFrame, key: str, text: str = "text", count: str | None = "n_entities") -> DataFrame:
    """``df`` with surrogates in its text column and, if named, a column with the number of entities.

    Null texts stay null and have 0 entities; texts without entities are
    unchanged. The same entity has the same surrogate in every row, different
    entities have different ones, and no surrogate is an entity of the corpus.
    Texts of any length are whole: patterns are bounded, or runs of one class of
    characters. Repeated rows stay; other columns pass through, one called like
    ``count`` is replaced. An empty table gives no rows. The rows are read twice:
    for the check, and for the replacing.
    """
    # own names inside, so that no column of the caller's can clash
    columns = {c: f"c{i}" for i, c in enumerate(df.columns)}
    df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in columns.items()])
    own = F.col(columns[text])
    maybe = F.coalesce(own.rlike(MAYBE), F.lit(False))
    titled = F.coalesce(own.rlike(_TITLE), F.lit(False))
    nobody = F.array().cast("array<string>")
    # a text without a title has no people: its pattern is always the same, and compiled once for texts in a row
    names = F.when(titled, _full_names(own)).otherwise(nobody)
    marked = df.withColumns({"__maybe": maybe, "__names": names}).where("__maybe")

    def found_in(names_: Column) -> Column:
        return F.regexp_extract_all(own, pattern_of(names_), F.lit(0))

    people = F.when(F.size("__names") > 0, _titled(own)).otherwise(F.array().cast("array<struct<person:string,gender:string>>"))
    listed = marked.select(F.explode(F.array_distinct(found_in(F.col("__names")))).alias("entity"), people.alias("people"))
    # one pass over the texts: what is listed is small, and written
    listed = listed.withColumn("kind", kind_of(F.col("entity")))
    canonical, is_name = canonical_of(F.col("entity"), F.col("kind")), F.col("kind") == "name"
    told = F.exists("people", lambda p: (p["person"] == F.col("canonical")) & (p["gender"] != "n"))
    listed = listed.withColumn("canonical", canonical).select(
        "kind",
        "canonical",
        F.when(is_name, gender_in(F.col("people"), F.col("canonical"))).alias("gender"),
        F.when(is_name, told).alias("told"),
    )
    listed = materialise(listed.distinct(), "listed")
    plain = listed.where(~is_name).select("kind", "canonical")
    named = listed.where(is_name).select(F.col("canonical").alias("person"), "gender", "told")
    settled, disputed = _people(named.where(F.col("person").contains(" ")))
    alone = named.where(~F.col("person").contains(" ")).select("person", F.lit("m").alias("gender"))  # family names only
    parts = settled.unionByName(alone).select(F.explode(name_parts(F.col("person"), F.col("gender"))).alias("p")).select("p.kind", "p.canonical")
    found = materialise(plain.unionByName(parts.where(F.col("kind").isin(*_DRAWN_PARTS))).distinct(), "entities")
    redrawn = _redrawn(found, key)
    lookups = [redrawn] if redrawn is not None else []
    if disputed is not None:
        lookups.append(disputed.select(F.lit("person").alias("kind"), F.col("person").alias("canonical"), F.col("gender").alias("surrogate")))

    columns = {c: n for c, n in columns.items() if count is None or c.lower() != count.lower()}

    def shown(part: DataFrame, table: Column | None) -> DataFrame:
        part = part.withColumns({"__maybe": maybe, "__names": names})
        part = part.withColumn("__entities", F.when(F.col("__maybe"), found_in(F.col("__names"))))
        replaced = _replaced(own, F.col("__entities"), pattern_of(F.col("__names")), people, key, table)
        new = F.when(F.size("__entities") > 0, replaced).otherwise(own).alias(text)
        number = [] if count is None else [F.greatest(F.coalesce(F.size("__entities"), F.lit(0)), F.lit(0)).cast("long").alias(count)]
        return part.select(*[new if c == text else F.col(n).alias(c) for c, n in columns.items()], *number)

    if not lookups:
        return shown(df, None)
    lookup = materialise(lookups[0] if len(lookups) == 1 else lookups[0].unionByName(lookups[1]), "lookups")
    rows = df.where(maybe).withColumn("__hash", F.xxhash64(own))
    uses = rows.withColumn("__names", names).select("__hash", F.explode(F.array_distinct(found_in(F.col("__names")))).alias("entity")).distinct()
    uses = uses.withColumn("kind", kind_of(F.col("entity")))
    uses = uses.withColumn("canonical", canonical_of(F.col("entity"), F.col("kind")))
    # a name may ask for its family, its given names as either gender, and the person
    asked = F.when(
        F.col("kind") == "name",
        F.concat(
            *[name_parts(F.col("canonical"), F.lit(g)) for g in ("m", "f")],
            F.array(F.struct(F.lit("person").alias("kind"), F.col("canonical").alias("canonical"))),
        ),
    ).otherwise(F.array(F.struct("kind", "canonical")))
    uses = uses.select("__hash", F.explode(asked).alias("a")).select("__hash", "a.kind", "a.canonical")
    tables = (
        uses.join(lookup.hint("merge"), ["kind", "canonical"])
        .select("__hash", F.concat_ws("\x01", "kind", "canonical").alias("entity"), "surrogate")
        .distinct()
        .groupBy("__hash")
        .agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("__table"))
    )
    # a text's copies may be many: those of a hot text stay where they lie
    copies = rows.groupBy("__hash").agg(F.count("*").alias("n"))
    tables = materialise(copies.join(tables.hint("merge"), "__hash", "left"), "tables")
    joined = join_per_key(rows, tables, "__hash")
    return shown(df.where(~maybe), None).unionByName(shown(joined.drop("n"), F.col("__table")))
