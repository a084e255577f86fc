"""Personal data replaced by keyed surrogates, in DataFrame functions alone.

Each entity is found by pattern and replaced by a value drawn from a keyed hash of its normal form: the same person, number
or address gets the same surrogate everywhere, of the same type, gender, script, case and punctuation. Names are entities
word by word: a first name and a surname have surrogates of their own, so a person named in full, by the surname or by
another title stays the same, and a word that a title has shown to be a name is replaced where it stands alone in the same
text too. A check over all distinct entities finds surrogates that two entities share or that equal a real entity; those
draw again, until none is left. Names that no title ever stands before are not found.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, discard, fresh

# Syllables of two letters by script, last syllables of first names by script and gender, titles by gender.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro".split(),
    "cyrillic": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со".split(),
    "greek": "βα βε βι βο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο".split(),
}
GIVEN_ENDS = {
    ("f", "latin"): "na ra la ma ta da sa ka".split(),
    ("m", "latin"): "no ro lo mo to do so ko".split(),
    ("n", "latin"): "ne re le me te de se ke".split(),
    ("f", "cyrillic"): "на ра ла ма та да са ка".split(),
    ("m", "cyrillic"): "он ор ол ом от од ос ок".split(),
    ("n", "cyrillic"): "не ре ле ме те де се ке".split(),
    ("f", "greek"): "να ρα λα μα τα δα σα κα".split(),
    ("m", "greek"): "ος ης ας ις ων ιν ορ ερ".split(),
    ("n", "greek"): "νε ρε λε με τε δε σε κε".split(),
}
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Dra", "Г-жа", "г-жа", "Κυρία")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "г-н", "Κύριος")
NEUTRAL_TITLES = ("Dr", "Prof", "Doctor", "Professor", "Mx")
HAN = "天地人山水火木金土日月星云雨雪"

_ONE_TITLE = "(?:" + "|".join(FEMALE_TITLES + MALE_TITLES + NEUTRAL_TITLES) + r")\.? "
_TITLE = f"(?:{_ONE_TITLE}){{1,3}}"
#: A capital and more letters; apostrophes and hyphens between letters. Up to three such words, of which but the last may be initials.
_NAME = r"\p{Lu}(?:['’-]?[\p{L}\p{M}])+"
_NAMES = rf"(?:(?:{_NAME}|\p{{Lu}}\.) ){{0,2}}{_NAME}"
_HEX = "[0-9A-Fa-f]"
_SHORT_IPV6 = rf"(?:{_HEX}{{1,4}}(?::{_HEX}{{1,4}})*)?::(?:{_HEX}{{1,4}}(?::{_HEX}{{1,4}})*)?"
_CARD = "[0-9](?:[ -]?[0-9]){12,18}"

#: Type -> pattern, in the order of trial at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}|(?=[A-Fa-f:]*[0-9])(?=(?::*{_HEX}){{5}}){_SHORT_IPV6})(?![0-9A-Za-z:])",
    "mac": rf"(?<![0-9A-Za-z:])(?:{_HEX}{{2}}:){{5}}{_HEX}{{2}}(?![0-9A-Za-z:])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "secret": rf"(?<![0-9A-Za-z]){_HEX}{{32,128}}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{{16}}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:gh[pousr]_|sk-)[0-9A-Za-z]{{20,}}|(?<=[=:\" ])(?<=[=:] ?\"?)(?<=(?:token|secret|password|api_key) ?[=:] ?\"?)[^\s\"]{{8,}}",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": rf"(?<![0-9])({_CARD})(?![0-9])",
    "name": rf"(?=[MFHSDPГгΚ])(?<!\p{{L}}){_TITLE}{_NAMES}",
}
#: Its one group takes numbers that are of the length of a card's and no secret by their context.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_KEYS = ("token", "secret", "password", "api_key")
#: Signs of entities that may have no digit, each cheap to look for: the start of one title with the rest of any, and runs of hex letters and between colons.
_TITLE_LIKE = "[" + "".join(sorted({t[0] for t in FEMALE_TITLES + MALE_TITLES + NEUTRAL_TITLES})) + "](?:" + "|".join(sorted({t[1:] for t in FEMALE_TITLES + MALE_TITLES + NEUTRAL_TITLES}, key=lambda t: (-len(t), t))) + r")\.? "
_SIGNS = ("[0-9@]", _TITLE_LIKE, "[A-Fa-f]{32}", f":{_HEX}{{1,4}}:")
_STARTS = ("AKIA", "ASIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")
#: Draws before the check gives up with an error, draws from which names and secrets grow longer, and redrawn entities up to which they go along as a literal.
MOST_DRAWS, LONGER_FROM, MOST_MOVED = 64, 8, 5_000


def hinted(text: Column) -> Column:
    """False for texts that cannot hold an entity; far cheaper than the full pattern."""
    out = F.lit(False)
    for sign in _SIGNS:
        out = out | text.rlike(sign)
    for start in _KEYS + _STARTS:
        out = out | F.contains(text, F.lit(start))
    return out


@dataclass(frozen=True)
class Keyed:
    """The surrogates of one secret key."""

    key: str

    def normal(self, kind: Column, m: Column) -> Column:
        """What two mentions of one entity have in common; of names, words are entities."""
        digits = F.regexp_replace(m, "[^0-9]", "")
        return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", F.upper(F.replace(m, F.lit(" "), F.lit("")))).otherwise(F.lower(m))

    def stream(self, kind: Column, normal: Column, nonce: Column) -> Column:
        """256 keyed hex digits."""
        seed = F.concat_ws("|", F.lit(self.key), kind, normal, nonce.cast("string"))
        return F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")), 256) for i in range(4)])

    @staticmethod
    def byte(stream: Column, i: Column) -> Column:
        return F.conv(F.substr(stream, F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def pick(self, stream: Column, i, syllables: Column, number: int) -> Column:
        """One of a number of syllables, a power of two, written one after the other."""
        return F.substr(syllables, self.byte(stream, F.lit(i) if isinstance(i, int) else i) % number * 2 + 1, F.lit(2))

    def shaped(self, m: Column, stream: Column, keep: Column, is_hex: Column, is_upper: Column) -> Column:
        """Digit for digit, letter for letter of the same case and script, hex digit for hex digit in hex texts; the first `keep` characters and all others stay. Digits are numbered among themselves, so that spacing changes none."""
        letters = lambda text, v: F.substr(F.lit(text), v % len(text) + 1, F.lit(1))

        def one(c: Column, i: Column) -> Column:
            place = F.when(c.rlike("^[0-9]$"), F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), "[^0-9]", "")) - 1).otherwise(i + 37)
            v = self.byte(stream, F.when(is_hex, i).otherwise(place))
            return (
                F.when(i < keep, c)
                .when(is_hex & c.rlike(f"^{_HEX}$"), F.when(is_upper, letters("0123456789ABCDEF", v)).otherwise(letters("0123456789abcdef", v)))
                .when(c.rlike("^[0-9]$"), (v % 10).cast("string"))
                .when(c.rlike(r"^[а-яё]$"), letters("абвгдежзиклмнопрстуфх", v))
                .when(c.rlike(r"^[А-ЯЁ]$"), letters("АБВГДЕЖЗИКЛМНОПРСТУФХ", v))
                .when(c.rlike(r"^[\p{IsGreek}&&\p{Ll}]$"), letters("αβγδεζηθικλμνοπρστυφχψω", v))
                .when(c.rlike(r"^[\p{IsGreek}&&\p{Lu}]$"), letters("ΑΒΓΔΕΖΗΘΙΚΛΜΝΟΠΡΣΤΥΦΧΨΩ", v))
                .when(c.rlike(r"^\p{Ll}$"), letters("abcdefghijklmnopqrstuvwxyz", v))
                .when(c.rlike(r"^\p{Lu}$"), letters("ABCDEFGHIJKLMNOPQRSTUVWXYZ", v))
                .when(c.rlike(r"^\p{IsHan}$"), letters(HAN, v))
                .when(c.rlike(r"^\p{L}$"), letters("abcdefghijklmnopqrstuvwxyz", v))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(m, ""), one), "")

    @staticmethod
    def luhn_sum(digits: Column, first_doubled: int) -> Column:
        """Over the digits from the right, doubling those whose place from the right has the parity of first_doubled."""
        n = F.length(digits)

        def add(acc: Column, i: Column) -> Column:
            d = F.substr(digits, n - i, F.lit(1)).cast("int")
            twice = d * 2
            return acc + F.when(i % 2 == first_doubled, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)

    def card(self, made: Column) -> Column:
        """The last digit makes it pass the check-digit test, as the original does."""
        body = F.regexp_replace(made, "[0-9]$", "")
        check = F.pmod(10 - self.luhn_sum(F.regexp_replace(body, "[^0-9]", ""), 0) % 10, F.lit(10))
        return F.concat(body, check.cast("string"))

    @staticmethod
    def iban(made: Column) -> Column:
        """The third and fourth character are check digits: read as a number with the country behind the account, the rest of the division by 97 is 1."""
        compact = F.upper(F.replace(made, F.lit(" "), F.lit("")))
        turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(2)), F.lit("00"))

        def step(acc: Column, c: Column) -> Column:
            v = F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
            return F.when(v < 10, acc * 10 + v).otherwise(acc * 100 + v) % 97

        rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
        return F.concat(F.substr(made, F.lit(1), F.lit(2)), F.lpad((98 - rest).cast("string"), 2, "0"), F.substr(made, F.lit(5)))

    def short_ipv6(self, m: Column, stream: Column) -> Column:
        """Each group becomes four hex digits."""
        return F.array_join(F.transform(F.split(m, ":"), lambda g, i: F.when(g == "", "").otherwise(F.substr(stream, F.lit(1) + i * 4, F.lit(4)))), ":")

    def email(self, m: Column, stream: Column) -> Column:
        """A local part of the same shape, 8 characters at least, under a domain that is reserved for examples."""
        plain = (F.lit(0), F.lit(False), F.lit(False))
        local = self.shaped(F.substring_index(m, "@", 1), stream, *plain)
        more = F.translate(F.substr(stream, F.lit(200), F.greatest(8 - F.length(local), F.lit(0))), "0123456789", "ghijklmnop")
        host = self.shaped(F.regexp_extract(m, r"@([^.]+)\.", 1), stream, *plain)
        return F.concat(local, more, F.lit("@"), host, F.lit(".example."), F.when(m.rlike(r"(?i)\.org$"), "org").when(m.rlike(r"(?i)\.net$"), "net").otherwise("com"))

    def ipv4(self, stream: Column) -> Column:
        return F.concat_ws(".", (self.byte(stream, F.lit(0)) % 223 + 1).cast("string"), *[self.byte(stream, F.lit(i)).cast("string") for i in (1, 2, 3)])

    @staticmethod
    def syllables(kind: Column, m: Column) -> tuple[Column, Column]:
        """The syllables of a word's script, and those that first names of its gender end in."""
        script = F.when(m.rlike(r"\p{IsCyrillic}"), "cyrillic").when(m.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        own = F.element_at(F.create_map(*[F.lit(x) for k, v in SYLLABLES.items() for x in (k, "".join(v))]), script)
        ends = F.element_at(F.create_map(*[F.lit(x) for (g, k), v in GIVEN_ENDS.items() for x in (f"given_{g}{k}", "".join(v))]), F.concat(kind, script))
        return own, ends

    def described(self, ms: Column) -> Column:
        """An array of mentions (m, card) as structs (title, parts), where a part is (m, kind, normal): the words of a name behind their title, or the whole mention. Each step is a transform of its own, so that what it makes is worked out once."""
        kinds = F.transform(ms, lambda x: F.struct(x["m"].alias("m"), kind_of(x["m"], x["card"]).alias("kind")))
        titled = F.transform(kinds, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), F.when(s["kind"] == "name", F.regexp_extract(s["m"], f"^{_TITLE}", 0)).otherwise("").alias("title")))

        def words(s: Column) -> Column:
            female, male = (s["title"].rlike(r"(?:^| )(?:" + "|".join(t) + r")\.? ") for t in (FEMALE_TITLES, MALE_TITLES))
            given = F.when(female, "given_f").when(male, "given_m").otherwise("given_n")
            own = F.split(F.substr(s["m"], F.length(s["title"]) + 1), " ")
            return F.transform(own, lambda w, i: F.struct(w.alias("m"), F.when(w.rlike(r"^\p{Lu}\.$"), "initial").when(i < F.size(own) - 1, given).otherwise("family").alias("kind"), F.lower(w).alias("normal")))

        whole = lambda s: F.array(F.struct(s["m"].alias("m"), s["kind"].alias("kind"), self.normal(s["kind"], s["m"]).alias("normal")))
        return F.transform(titled, lambda s: F.struct(s["title"].alias("title"), F.when(s["kind"] == "name", words(s)).otherwise(whole(s)).alias("parts")))

    def drawn(self, parts: Column, nonce) -> Column:
        """The surrogates of an array of parts; nonce gives the number of the draw for one of them. A number that is no card stays."""

        def seeded(s: Column) -> Column:
            m, kind = s["m"], s["kind"]
            keep = F.when(kind == "phone", F.greatest(F.length(F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)), F.length(F.regexp_extract(m, r"^\+[0-9]", 0)))).when(kind == "iban", 2).when(kind == "secret", F.length(F.regexp_extract(m, "^(?:AKIA|ASIA|gh[pousr]_|sk-)", 0))).otherwise(0)
            named = F.startswith(kind, F.lit("given")) | kind.isin("family", "initial")
            own = {"nonce": nonce(s), "keep": keep, "is_hex": m.rlike(rf"^{_HEX}{{32,}}$|^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "is_upper": m == F.upper(m), "named": named}
            return F.struct(m.alias("m"), kind.alias("kind"), s["normal"].alias("normal"), *[c.alias(k) for k, c in own.items()])

        def streamed(s: Column) -> Column:
            own, ends = self.syllables(s["kind"], s["m"])
            made = {"stream": self.stream(s["kind"], s["normal"], s["nonce"]), "own": F.when(s["named"], own), "ends": F.when(s["named"] & F.startswith(s["kind"], F.lit("given")), ends)}
            return F.struct(*[s[k].alias(k) for k in ("m", "kind", "nonce", "keep", "is_hex", "is_upper", "named")], *[c.alias(k) for k, c in made.items()])

        def shaped(s: Column) -> Column:
            """For a name its front and its last two syllables; late draws put a syllable each into the front."""
            stream, own = s["stream"], s["own"]
            more = F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(s["nonce"] - LONGER_FROM, F.lit(0))), lambda i: F.when(i > 0, self.pick(stream, i + 8, own, 32)).otherwise("")), "")
            front = F.when(s["named"], F.concat(self.pick(stream, 0, own, 32), more, self.pick(stream, 1, own, 32)))
            rest = F.when(s["named"], F.concat(self.pick(stream, 2, own, 32), F.coalesce(self.pick(stream, 3, s["ends"], 8), self.pick(stream, 3, own, 32))))
            made = F.when(s["kind"].isin("ipv6", "mac", "secret", "iban", "phone", "ssn", "card"), self.shaped(s["m"], stream, s["keep"], s["is_hex"], s["is_upper"]))
            return F.struct(*[s[k].alias(k) for k in ("m", "kind", "nonce", "stream", "is_upper", "named")], made.alias("made"), front.alias("front"), rest.alias("rest"))

        def spelled(s: Column) -> Column:
            """A name of two halves where it has a hyphen."""
            word = F.when(F.contains(s["m"], F.lit("-")), F.concat(F.initcap(s["front"]), F.lit("-"), F.initcap(s["rest"]))).otherwise(F.initcap(F.concat(s["front"], s["rest"])))
            return F.struct(*[s[k].alias(k) for k in ("m", "kind", "nonce", "stream", "is_upper", "named", "made")], F.when(s["named"], word).alias("word"))

        def one(s: Column) -> Column:
            kind, m, made, word = s["kind"], s["m"], s["made"], s["word"]
            bare = (F.length(F.regexp_replace(m, r"[^\p{L}0-9]", "")) < 8) | (s["nonce"] >= LONGER_FROM)  # a shape with too few values
            return (
                F.when(kind == "initial", F.concat(F.substr(word, F.lit(1), F.lit(1)), F.lit(".")))
                .when(s["named"], F.when(s["is_upper"] & (F.length(m) > 1), F.upper(word)).otherwise(word))
                .when(kind == "email", self.email(m, s["stream"]))
                .when(kind == "ipv4", self.ipv4(s["stream"]))
                .when(kind == "card", self.card(made))
                .when(kind == "iban", self.iban(made))
                .when((kind == "ipv6") & F.contains(m, F.lit("::")), self.short_ipv6(m, s["stream"]))
                .when((kind == "secret") & bare, F.substr(s["stream"], F.lit(1), F.greatest(F.lit(16), F.least(F.lit(256), F.length(m)))))
                .when((kind == "phone") & (s["nonce"] >= LONGER_FROM), F.concat(made, F.translate(F.substr(s["stream"], F.lit(101), s["nonce"] - LONGER_FROM + 1), "abcdef", "012345")))
                .when(kind == "number", m)
                .otherwise(made)
            )

        out = parts
        for stage in (seeded, streamed, shaped, spelled, one):
            out = F.transform(out, stage)
        return out


def kind_of(m: Column, card: Column) -> Column:
    """The first type whose pattern takes the whole match. A number of a card's length is a card if its check digit is right."""
    own = {"email": "@", "ipv6": rf"^(?:{_HEX}{{1,4}}:){{7}}|^[0-9A-Fa-f:]*::[0-9A-Fa-f:]*$", "mac": rf"^(?:{_HEX}{{2}}:){{5}}", "ipv4": r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$", "name": f"^{_TITLE}{_NAME}|^{_TITLE}\\p{{Lu}}\\. ", "ssn": "^" + PATTERNS["ssn"] + "$"}
    valid = Keyed.luhn_sum(F.regexp_replace(m, "[^0-9]", ""), 1) % 10 == 0
    out = F.when(card != "", F.when(valid, "card").otherwise("number"))
    for kind, pattern in own.items():
        out = out.when(m.rlike(pattern), kind)
    out = out.when(m.rlike(rf"^{_HEX}{{32,128}}$"), "secret").when(m.rlike("^" + PATTERNS["iban"] + "$"), "iban").when(m.rlike(r"^(?:\+|\()|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$"), "phone")
    return out.otherwise("secret")


def mentions(text: Column) -> Column:
    """(m, card) of all matches; card is the match again where it is a number of a card's length and no secret by its context."""
    ms = F.when(hinted(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))

    def with_cards(own: Column) -> Column:
        cards = F.when(F.exists(own, lambda m: m.rlike(f"^{_CARD}$")), F.regexp_extract_all(text, F.lit(ANY), F.lit(1))).otherwise(F.array().cast("array<string>"))
        return F.zip_with(own, cards, lambda m, c: F.struct(m.alias("m"), F.coalesce(c, F.lit("")).alias("card")))

    return F.transform(F.array(ms), lambda own: F.when(own.isNotNull(), with_cards(own)))[0]


def redrawn(docs: DataFrame, text_col: str, keyed: Keyed) -> DataFrame | None:
    """(kind, normal, nonce) of the entities whose first surrogate is not theirs alone, as a written table; None if there are none."""
    parts = F.flatten(F.transform(keyed.described(mentions(F.col(f"`{text_col}`"))), lambda s: s["parts"]))
    found = docs.select(F.explode(parts).alias("e")).select("e.*").filter(~F.col("kind").isin("initial", "number"))
    entities = checkpointed(found.groupBy("kind", "normal").agg(F.min("m").alias("m")))
    # words of names are told apart whatever their place in a name
    group = F.when(F.startswith("kind", F.lit("given")) | (F.col("kind") == "family"), "name").otherwise(F.col("kind"))
    real = entities.select(group.alias("group"), F.col("normal").alias("v"), F.lit("").alias("entity"), F.lit(1).alias("real")).distinct()
    chosen = entities.select("kind", "normal", "m", F.lit(0).alias("nonce"))
    moved = None
    for nonce in range(1, MOST_DRAWS + 1):
        drawn = keyed.drawn(F.array(F.struct("m", "kind", "normal")), lambda s: F.col("nonce"))[0]
        made = chosen.withColumn("drawn", drawn).select("kind", "normal", group.alias("group"), keyed.normal(F.col("kind"), F.col("drawn")).alias("v"), F.concat_ws("|", "kind", "normal").alias("entity"))
        claims = made.select("group", "v", "entity", F.lit(0).alias("real")).union(real)
        # a value belongs to the real entity of that form, or else to the least of those that drew it
        owner = claims.groupBy("group", "v").agg(F.max("real").alias("real"), F.min(F.when(F.col("real") == 0, F.col("entity"))).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        lost = checkpointed(made.join(owner, ["group", "v"]).filter((F.col("real") == 1) | (F.col("entity") != F.col("first"))).select("kind", "normal"))
        if lost.isEmpty():
            discard(lost, entities)
            return moved
        before, again = chosen, lost.withColumn("to", F.lit(nonce))
        chosen = checkpointed(chosen.join(again, ["kind", "normal"], "left").select("kind", "normal", "m", F.coalesce("to", "nonce").alias("nonce")))
        discard(lost, *([before] if moved is not None else []))
        moved = chosen.filter("nonce > 0").select("kind", "normal", "nonce")
    raise ValueError(f"entities share surrogates after {MOST_DRAWS} draws")


def literal_nonces(moved: DataFrame):
    """The draw of a part as a column, out of a literal of bounded size."""
    slots: list[dict[str, int]] = [{} for _ in range(256)]
    for r in moved.select("kind", "normal", "nonce", F.pmod(F.xxhash64("kind", "normal"), F.lit(256)).alias("slot")).collect():  # MOST_MOVED rows at most
        slots[r["slot"]][f"{r['kind']}|{r['normal']}"] = r["nonce"]
    held = F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), "array<map<string,int>>")

    def nonce(s: Column) -> Column:
        slot = F.element_at(held, (F.pmod(F.xxhash64(s["kind"], s["normal"]), F.lit(256)) + 1).cast("int"))
        return F.coalesce(slot[F.concat_ws("|", s["kind"], s["normal"])], F.lit(0))

    return nonce


def replace_personal_data(docs: DataFrame, key: str, text_col: str = "text", n_chars_col: str | None = "n_chars", count_into: str | None = None) -> DataFrame:
    """The documents with surrogates in their texts; all columns stay, n_chars, if there, follows, and count_into names a column for the number of mentions.

    A null text stays null, an empty one empty. Equal texts get equal results; rows that repeat and null ids all stay; an
    empty table gives no rows. No document is shuffled while up to MOST_MOVED entities had to draw again; beyond that, only
    texts with an entity are joined with the draws of their own.
    """
    keyed = Keyed(key)
    moved = redrawn(docs, text_col, keyed)
    text, fixes, m = F.col(f"`{text_col}`"), fresh(docs, "__fixes"), fresh(docs, "__m")
    rows = docs.withColumn(m, mentions(text))
    if moved is None:
        return rewritten(rows, docs, keyed, lambda s: F.lit(0), m, text_col, n_chars_col, count_into)
    if moved.count() <= MOST_MOVED:
        return rewritten(rows, docs, keyed, literal_nonces(moved), m, text_col, n_chars_col, count_into)
    mine, has = fresh(docs, "__md5"), F.size(m) > 0
    parts = F.flatten(F.transform(keyed.described(mentions(text)), lambda s: s["parts"]))
    own = docs.select(F.md5(text).alias(mine), F.explode(parts).alias("e")).select(mine, "e.kind", "e.normal").distinct().join(moved, ["kind", "normal"])
    by_text = own.groupBy(mine).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "normal").alias("k"), "nonce"))).alias(fixes))
    joined = rows.filter(has).withColumn(mine, F.md5(text)).join(by_text, mine, "left").drop(mine)
    plain = rows.filter(F.coalesce(~has, F.lit(True))).withColumn(fixes, F.lit(None).cast("map<string,int>"))
    nonce = lambda s: F.coalesce(F.col(fixes)[F.concat_ws("|", s["kind"], s["normal"])], F.lit(0))
    return rewritten(joined.unionByName(plain), docs, keyed, nonce, m, text_col, n_chars_col, count_into)


def words_of(made: Column) -> Column:
    """The words of names in mentions, and what stands for them, for the gaps between the mentions."""
    pairs = F.transform(F.filter(made, lambda s: s["title"] != ""), lambda s: F.zip_with(s["parts"], s["drawn"], lambda p, d: F.struct(p["m"].alias("w"), p["kind"].alias("kind"), d.alias("d"))))
    return F.array_distinct(F.filter(F.flatten(pairs), lambda p: p["kind"] != "initial"))


def rewritten(rows: DataFrame, docs: DataFrame, keyed: Keyed, nonce, m: str, text_col: str, n_chars_col: str | None, count_into: str | None) -> DataFrame:
    """The columns of docs with surrogates for the mentions in column m."""
    text = F.col(f"`{text_col}`")
    made = F.transform(keyed.described(F.col(m)), lambda s: F.struct(s["title"].alias("title"), s["parts"].alias("parts"), keyed.drawn(s["parts"], nonce).alias("drawn")))
    alone = lambda gap, p: F.regexp_replace(gap, F.concat(F.lit(r"(?<![\p{L}\p{M}'’-])"), p["w"], F.lit(r"(?!['’-]?[\p{L}\p{M}])")), p["d"])

    def joined(got: Column) -> Column:
        between = F.split(text, ANY, -1)
        gaps = F.when(F.size(got["words"]) > 0, F.transform(between, lambda g: F.aggregate(got["words"], g, alone))).otherwise(between)
        return F.array_join(F.zip_with(gaps, got["made"], lambda a, b: F.concat(a, F.coalesce(F.concat(b["title"], F.array_join(b["drawn"], " ")), F.lit("")))), "")

    staged = F.transform(F.transform(F.array(F.struct(made.alias("made"))), lambda x: F.struct(x["made"].alias("made"), words_of(x["made"]).alias("words"))), joined)
    out = F.when(F.size(m) > 0, staged[0]).otherwise(text)
    names = [c for c in docs.columns if c != text_col]
    number = fresh(docs, "__n")
    real = F.size(F.filter(F.col(m), lambda x: kind_of(x["m"], x["card"]) != "number")) if count_into else F.lit(0)
    result = rows.select(*[F.col(f"`{c}`") for c in names], out.alias(text_col), F.coalesce(real, F.lit(0)).alias(number))
    if n_chars_col and n_chars_col in docs.columns:
        result = result.withColumn(n_chars_col, F.length(text_col).cast(docs.schema[n_chars_col].dataType))
    if count_into:
        return result.select(*docs.columns, F.greatest(number, F.lit(0)).cast("long").alias(count_into))
    return result.select(*docs.columns)
