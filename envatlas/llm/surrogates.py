"""Surrogate generation for personal data, in DataFrame functions only.

Detected entities (emails, IPv4 and IPv6 addresses, phone numbers, card numbers, social security numbers, IBANs, secrets of known forms, and names
after a title, a known given name or words that announce a name) are replaced by keyed surrogates of the same type: digits for digits, letters for letters of
the same script and case, Luhn-valid numbers for Luhn-valid ones, octets for octets, and names of the same gender and script.
Letters of scripts without a table here become Latin ones. Separators, brackets, titles, top-level domains and leading digits of cards and country codes stay.

A surrogate is a function of the key, the type and the entity's normal form, so that all mentions of one entity, however
spelled, stay one entity across the corpus (coreference); a domain, a given name or a surname keeps its surrogate in every entity. Over all
distinct entities, domains and parts of names among them, a collision check gives another surrogate to each that would share one or that would
become a real entity of the corpus (distinctness). Where the forms of the entity's own length run out, surrogates grow longer; IPv4 addresses
cannot: after OWN_ROUNDS rounds theirs may be real addresses of the corpus, but still no two share one. Initials are replaced letter by letter.

Texts are scanned once. What the scan found is written with the rows, and all that follows reads that.

Null text stays null; text without entities stays as it is, byte for byte. Repeated rows get equal results. An empty table gives no rows.
All input columns come back; `n_entities` is added (a clashing name takes a trailing underscore).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from envatlas.llm.shared import column_named, drop, save

KEY = "surrogate-key-1"
#: Rounds after which a surrogate that cannot grow may be a real entity's form.
OWN_ROUNDS = 20
#: Attempts of the entity's own length; each later one is longer by one, so that no space of short forms runs out.
SAME_LENGTH = 3

# Titles and common given names by gender.
TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Signora", "госпожа")
TITLES_M = ("Mr", "Mister", "Herr", "Señor", "Monsieur", "Signor", "господин")
TITLES_N = ("Dr", "Prof")
GIVEN_F = ("Mary", "Anna", "Maria", "Sarah", "Emma", "Laura", "Julia", "Sophie", "Elena", "Carmen", "Claire", "Katharina", "Linda", "Jennifer", "Elizabeth", "Isabel", "Camille", "Ursula", "Olga", "Patricia", "Barbara", "Susan", "Jessica", "Karen", "Nancy", "Lisa", "Margaret", "Sandra", "Ashley", "Emily", "Michelle", "Amanda", "Melissa", "Deborah", "Stephanie", "Rebecca", "Helen", "Alice", "Fatima", "Aisha", "Priya", "Lakshmi", "Yuki", "Mei", "Ingrid", "Giulia", "Francesca", "Lucía", "Sofía", "Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина")
GIVEN_M = ("James", "John", "Robert", "Michael", "David", "Thomas", "Peter", "Hans", "Jürgen", "Pierre", "Jean", "Carlos", "José", "Antonio", "Luis", "William", "Richard", "Klaus", "Ivan", "Joseph", "Charles", "Christopher", "Daniel", "Matthew", "Anthony", "Steven", "Andrew", "Kenneth", "George", "Joshua", "Kevin", "Brian", "Edward", "Ronald", "Timothy", "Jason", "Ahmed", "Mohammed", "Omar", "Raj", "Arjun", "Hiroshi", "Wei", "Sven", "Lars", "Marco", "Giovanni", "Miguel", "Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Владимир")
#: Words after which a name stands.
ANNOUNCED = ("[Nn]ame is", "[Nn]ame:", "[Cc]ontact person:", "[Ii]ch heiße", "[Mm]e llamo", "[Jj]e m['’]appelle")
#: One-digit and two-digit country codes; all others have three digits.
COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
SECRET_STARTS = ("AKIA", "ASIA", "AIza", "gh[pousr]_", "github_pat_", "glpat-", "xox[abeoprs]-", "sk-", "[sr]k_(?:live|test)_", "eyJ")

_WORD = r"\p{Lu}[\p{L}'’-]{1,40}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
_INITIAL = r"(?:\p{Lu}\. )*"
#: Each pattern begins with what it may begin with, so that most places of a text are passed at a look.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,256}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])",
    "ip": rf"(?=[0-9])(?<![\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\p{{N}})",
    "ip6": rf"(?=[0-9A-Fa-f])(?<![\p{{L}}\p{{N}}:])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,6}}|{_HEX}:(?::{_HEX}){{2,6}})(?![\p{{L}}\p{{N}}:])",
    "iban": r"(?=[A-Za-z]{2}[0-9])(?<![\p{L}\p{N}])(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?: ?[0-9]{4}){3,7}(?: ?[0-9]{1,3})?)(?![\p{L}\p{N}])",
    "secret": r"(?=[0-9A-Fa-fegsrx])(?<![\p{L}\p{N}])(?:(?:AKIA|ASIA)[0-9A-Z]{16,}|AIza[0-9A-Za-z_-]{30,}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![\p{L}\p{N}])",
    "card": r"(?=[0-9])(?<!\p{N})(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?!\p{N})",
    "phone": r"(?=[+(0-9])(?<![\p{L}\p{N}])(?:\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+(?!1[ .(-])[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\p{N})",
    "ssn": r"(?=[0-9])(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])",
    "name": rf"(?=[\p{{Lu}}г])(?<![\p{{L}}\p{{N}}])(?:(?:{'|'.join(TITLES_F + TITLES_M + TITLES_N)})\.? {_INITIAL}{_WORD}(?: {_INITIAL}{_WORD})?|(?:{'|'.join(GIVEN_F + GIVEN_M)}) {_INITIAL}{_WORD}|(?:{'|'.join(f'(?<={x} )' for x in ANNOUNCED)}){_WORD} {_INITIAL}{_WORD})(?!\p{{L}})",
}
#: No entity begins inside a word, but for a number right after a letter.
_START = r"(?:(?<![\p{L}\p{N}])|(?<=\p{L})(?=[0-9]))"
ANY = _START + "(?:" + "|".join(p if k != "card" else p.replace(r"([ -])", r"(?<gap>[ -])").replace(r"\1", r"\k<gap>") for k, p in PATTERNS.items()) + ")"

_LETTERS = (("abcdefghijklmnopqrstuvwxyz", "a-z"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A-Z"), ("àâäçéèêëíîïóôöúùûüñ", "ß-öø-ÿ"), ("ÀÂÄÇÉÈÊËÍÎÏÓÔÖÚÙÛÜÑ", "À-ÖØ-Þ"), ("абвгдежзиклмнопрстуфхцчшэюя", "а-яё"), ("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "А-ЯЁ"), ("αβγδεζηθικλμνξοπρστυφχψω", "α-ω"), ("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "Α-Ω"))
#: Letters and digits beyond these, by script; those of scripts not listed become Latin ones.
_SCRIPTS = (
    ("ąćčďęěğłńňőřśşšťůűźżž", r"\p{IsLatin}&&\p{Ll}"), ("ĄĆČĎĘĚĞŁŃŇŐŘŚŞŠŤŮŰŹŻŽ", r"\p{IsLatin}&&\p{Lu}"), (_LETTERS[4][0], r"\p{IsCyrillic}&&\p{Ll}"), (_LETTERS[5][0], r"\p{IsCyrillic}&&\p{Lu}"), (_LETTERS[6][0], r"\p{IsGreek}&&\p{Ll}"), (_LETTERS[7][0], r"\p{IsGreek}&&\p{Lu}"),
    ("天地人山水火木金土日月星風雨花草鳥魚馬牛羊石田川林森村町海空春夏秋冬東西南北", r"\p{IsHan}"), ("あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ", r"\p{IsHiragana}&&\p{L}"), ("アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ", r"\p{IsKatakana}&&\p{L}"), ("가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추", r"\p{IsHangul}&&\p{L}"),
    ("ابتثجحخدذرزسشصضطظعغفقكلمنهوي", r"\p{IsArabic}&&\p{L}"), ("אבגדהוזחטיכלמנסעפצקרשת", r"\p{IsHebrew}&&\p{L}"), ("กขคงจฉชซญดตถทธนบปผพฟมยรลวศสหอ", r"\p{IsThai}&&\p{L}"), ("कखगघचछजझटठडढतथदधनपफबभमयरलवशसह", r"\p{IsDevanagari}&&\p{L}"), ("٠١٢٣٤٥٦٧٨٩", "٠-٩"),
    (_LETTERS[1][0], r"\p{Lu}"), (_LETTERS[0][0], r"\p{L}"), ("0123456789", r"\p{N}"),
)
_SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe ga ge go ha he jo ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te ti to va ve vi wa we za".split(), "lin ron mar bert dan gor nik tor".split(), "la na ra sa lia nia".split(), "man ley sen berg ford ton well kamp".split(), "man ley sen berg ford ton well kamp".split()),
    "cyrillic": ("ба бе бо ва ве ви га го да де до за зе ка ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се со та те ти то".split(), "рид мир слав дан тон лий рат".split(), "ла на ра ня лия".split(), "нов ров лин".split(), "нова рова лина".split()),
}


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 hex digits from the key and what names the entity."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string"))
    return F.concat(F.sha2(F.concat(seed, F.lit("\x1f0")), 256), F.sha2(F.concat(seed, F.lit("\x1f1")), 256))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i * 2) % 126 + 1, 3), 16, 10).cast("int")


def _pick(words: list[str] | str, n: Column) -> Column:
    if isinstance(words, str):
        return F.substring(F.lit(words), n % len(words) + 1, F.lit(1))
    return F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))


def _like(text: Column, stream: Column, hexadecimal: bool = False, scripts: bool = False) -> Column:
    """Each digit and letter replaced by another of its kind, script and case, of any script if so told; all else as it is."""

    def one(c: Column, i: Column, s: Column) -> Column:
        b = _byte(s, i + 1)
        if hexadecimal:
            return F.when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", b)).when(c.rlike("[A-F]"), _pick("ABCDEF", b)).otherwise(c)
        out = F.when(c.rlike("[0-9]"), _pick("0123456789", b))
        for letters, span in _LETTERS:
            out = out.when(c.rlike(f"[{span}]"), _pick(letters, b))
        for letters, span in _SCRIPTS if scripts else ():
            out = out.when(c.rlike(f"[{span}]"), _pick(letters, b))
        return out.otherwise(c)

    # split, and the stream bound once, as a substring or a digest at each place would cost the square of the length
    whole = F.element_at(F.transform(F.array(stream), lambda s: F.array_join(F.transform(F.split(text, ""), lambda c, i: one(c, i, s)), "")), 1)
    return F.when(F.length(text) > 0, whole).otherwise(F.lit(""))


def _longer(words: list[str] | str, stream: Column, attempt: Column, same: int = SAME_LENGTH, first: int = 22, step: int = 1) -> Column:
    """Nothing in the first attempts, then one more of `words` with each."""
    return F.when(attempt > same, F.array_join(F.transform(F.sequence(F.lit(0), attempt - same - 1), lambda i: _pick(words, _byte(stream, i * step + first))), "")).otherwise(F.lit(""))


def _surrogate(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The surrogate of a normal form, as a normal form."""
    s = _stream(key, kind, norm, attempt)
    digits = _like(norm, s)
    tail = _longer("0123456789", s, attempt)
    body = F.concat(F.substring(norm, 1, 1), F.substring(digits, F.lit(2), F.length(norm) - 2), tail)
    check = F.element_at(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(body, d.cast("string")))), 1)
    card = F.when(F.call_function("luhn_check", norm), F.concat(body, check.cast("string"))).otherwise(F.concat(body, F.substring(digits, -1, 1)))
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_byte(s, i) % 254 + 1).cast("string")), ".")
    code = F.regexp_extract(norm, f"^{COUNTRY}", 0)
    phone = F.when(norm.startswith("+"), F.concat(code, F.substring(digits, F.length(code) + 1, F.length(norm)))).otherwise(digits)
    at = F.instr(norm, "@")
    # an email's domain is an entity of its own; here it only tells the locals of one domain from those of another
    email = F.concat(_like(F.substring(norm, F.lit(1), at - 1), s, scripts=True), _longer(_LETTERS[0][0], s, attempt), F.substring(norm, at, F.length(norm)))
    top = F.substring_index(norm, ".", -1)
    domain = F.concat(_like(F.substring(norm, F.lit(1), F.length(norm) - F.length(top) - 1), s, scripts=True), _longer(_LETTERS[0][0], s, attempt), F.lit("."), top)
    ip6 = F.concat(_like(norm, s, True), _longer("0123456789abcdef", s, attempt))
    iban = F.concat(F.substring(norm, 1, 2), F.substring(digits, F.lit(3), F.length(norm)))
    prefix = F.regexp_extract(norm, f"^({'|'.join(SECRET_STARTS)})", 1)
    secret = F.concat(F.when(norm.rlike("^[0-9a-f]+$"), _like(norm, s, True)).otherwise(F.concat(prefix, F.substring(digits, F.length(prefix) + 1, F.length(norm)))), tail)
    scripts = {}
    for script, (middle, end_m, end_f, last_m, last_f) in _SYLLABLES.items():
        ends = F.when(kind == "given_f", _pick(end_f, _byte(s, F.lit(3)))).when(kind == "given_m", _pick(end_m, _byte(s, F.lit(3)))).when(kind == "given_n", _pick(end_m + end_f, _byte(s, F.lit(3))))
        ends = ends.when(kind == "surname_f", _pick(last_f, _byte(s, F.lit(3)))).otherwise(_pick(last_m, _byte(s, F.lit(3))))
        # longer with each attempt, so that distinct names never run out
        more = _longer(middle, s, attempt, 5, 5, 10)
        whole = F.concat(_pick(middle, _byte(s, F.lit(7))), _pick(middle, _byte(s, F.lit(9))), F.when(kind.startswith("surname"), _pick(middle, _byte(s, F.lit(11)))).otherwise(F.lit("")), more, ends)
        scripts[script] = whole
    out = F.when(kind == "email", email).when(kind == "domain", domain).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "card", card).when(kind == "phone", F.concat(phone, tail)).when(kind == "ssn", F.concat(digits, tail))
    return out.when(kind == "iban", F.concat(iban, tail)).when(kind == "secret", secret).otherwise(F.when(norm.rlike(r"\p{IsCyrillic}"), scripts["cyrillic"]).otherwise(scripts["latin"]))


def _kind(e: Column) -> Column:
    """The type of a detected entity; kinds are tried in the order of the pattern."""
    out = None
    for kind, p in PATTERNS.items():
        hit = F.lit(True) if kind == "name" else e.rlike(f"^(?:{p})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def _norm(kind: Column, e: Column) -> Column:
    digits = F.regexp_replace(e, "[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(e)).when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.when(e.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits))
        .when(kind == "iban", F.upper(F.replace(e, F.lit(" ")))).when(kind == "ip6", F.lower(e)).when(kind == "secret", F.when(e.rlike("^[0-9A-F]+$"), F.lower(e)).otherwise(e))
        .when(kind == "ip", e).otherwise(F.lower(e))
    )


def _parts(said: DataFrame) -> DataFrame:
    """(e, j, kind, norm, said): the parts of distinct entities (e, kind), which stand one after the other: a name's words, an email's local part and its domain; others have one part."""
    named = said.where("kind = 'name'").withColumn("all", F.split("e", " ")).withColumn("words", F.filter("all", lambda w: ~w.rlike(r"^\p{Lu}\.$")))
    named = named.withColumn("title", F.rtrim(F.element_at("words", 1), F.lit("."))).withColumn("titled", F.col("title").isin(*TITLES_F, *TITLES_M, *TITLES_N))
    named = named.withColumn("given", F.when(F.col("titled"), F.when(F.size("words") > 2, F.element_at("words", 2))).otherwise(F.element_at("words", 1)))
    woman = (F.col("titled") & F.col("title").isin(*TITLES_F)) | F.coalesce(F.col("given").isin(*GIVEN_F), F.lit(False))
    man = (F.col("titled") & F.col("title").isin(*TITLES_M)) | F.coalesce(F.col("given").isin(*GIVEN_M), F.lit(False))
    named = named.withColumn("gender", F.when(woman, "f").when(man, "m").otherwise("n"))
    each = named.select("e", "titled", "given", "gender", (F.size("all") - 1).alias("last"), F.posexplode("all").alias("j", "said"))
    # only Cyrillic surnames have a gender
    family = F.when(F.col("said").rlike(r"\p{IsCyrillic}") & (F.col("gender") == "f"), "surname_f").otherwise("surname")
    kind = F.when((F.col("j") == 0) & F.col("titled"), "title").when(F.col("said").rlike(r"^\p{Lu}\.$"), "initial").when((F.col("j") < F.col("last")) & F.col("said").eqNullSafe(F.col("given")), F.concat(F.lit("given_"), "gender")).otherwise(family)
    names = each.select("e", "j", kind.alias("kind"), F.lower("said").alias("norm"), "said")
    at = F.instr("e", "@")
    domain = F.substring(F.col("e"), at + 1, F.length("e"))
    emails = said.where("kind = 'email'").select("e", F.posexplode(F.array(F.struct(F.lit("email").alias("kind"), F.lower("e").alias("norm"), F.substring(F.col("e"), F.lit(1), at - 1).alias("said")), F.struct(F.lit("domain").alias("kind"), F.lower(domain).alias("norm"), domain.alias("said")))).alias("j", "x")).select("e", "j", "x.*")
    others = said.where("kind not in ('name', 'email')").select("e", F.lit(0).alias("j"), "kind", _norm(F.col("kind"), F.col("e")).alias("norm"), F.col("e").alias("said"))
    return names.unionByName(emails).unionByName(others)


def _initial(said: Column, key: str = KEY) -> Column:
    """Another Latin capital for an initial, one and the same for each letter."""
    letter, n = F.substring(said, 1, 1), _byte(_stream(key, F.lit("initial"), said, F.lit(0)), F.lit(1)) % 25 + 1
    return F.concat(F.substring(F.lit(_LETTERS[1][0] * 2), F.coalesce(F.instr(F.lit(_LETTERS[1][0]), letter), F.lit(0)) + n, F.lit(1)), F.lit("."))


def _dressed(kind: Column, said: Column, new: Column) -> Column:
    """The surrogate's normal form in the format of what was said: case, separators and blanks."""
    place = lambda i, of: F.length(F.regexp_replace(F.substring(said, F.lit(1), i), of, ""))

    def laid(keep: str, drop_: str) -> Column:
        laid_out = F.array_join(F.transform(F.sequence(F.lit(1), F.length(said)), lambda i: F.when(F.substring(said, i, F.lit(1)).rlike(keep), F.substring(new, place(i, drop_), F.lit(1))).otherwise(F.substring(said, i, F.lit(1)))), "")
        # surrogates may be longer than what was said
        return F.concat(laid_out, F.substring(new, place(F.length(said), drop_) + 1, F.length(new)))

    upper = (said == F.upper(said)) & (said != F.lower(said))
    local = F.substring_index(new, "@", 1)
    name = F.when(upper & (F.length(said) > 1), F.upper(new)).otherwise(F.initcap(new))
    return (
        F.when(kind.isin("card", "ssn"), laid("[0-9]", "[^0-9]")).when(kind == "phone", laid("[0-9+]", "[^0-9+]")).when(kind == "iban", F.when(said == F.lower(said), F.lower(laid("[^ ]", " "))).otherwise(laid("[^ ]", " ")))
        .when(kind == "email", F.concat(F.when(upper, F.upper(local)).otherwise(local), F.lit("@"))).when(kind == "domain", F.when(upper, F.upper(new)).otherwise(new)).when(kind == "secret", F.when(said.rlike("^[0-9A-F]+$"), F.upper(new)).otherwise(new))
        .when(kind == "ip", new).when(kind == "ip6", F.when(upper, F.upper(new)).otherwise(new)).when(kind == "title", said).when(kind == "initial", _initial(said)).otherwise(name)
    )


def surrogate_map(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, new) for the distinct (kind, norm) of `entities`: no two of a kind share a surrogate, and none gets a real entity's form.

    Each round settles all entities but those whose surrogate another one has; surrogates grow from round to round, so that few rounds settle all.
    """
    real = save(entities.select("kind", "norm").distinct(), "entities")
    family = F.regexp_replace("kind", "_[fmn]$", "")
    taken = real.select(family.alias("family"), F.col("norm").alias("new")).distinct()
    done, open_, attempt = None, real, 0
    while True:
        new = open_.select("kind", "norm", family.alias("family"), _surrogate(key, F.col("kind"), F.col("norm"), F.lit(attempt)).alias("new"))
        first = new.groupBy("family", "new").agg(F.min(F.struct("norm", "kind")).alias("x"))
        won = first.join(taken if attempt < OWN_ROUNDS else taken.where("family <> 'ip'"), ["family", "new"], "left_anti").select("x.kind", "x.norm", "new", "family")
        if done is not None:
            won = won.join(done.select("family", "new"), ["family", "new"], "left_anti").select("kind", "norm", "new", "family").union(done)
        now = save(won, "surrogates")
        left = real.join(now, ["kind", "norm"], "left_anti")
        if not left.limit(1).count():
            return now.drop("family")
        drop(*([done] if done is not None else []))
        done, open_, attempt = now, left, attempt + 1


def replace(df: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """The rows with surrogates in `text`, and n_entities. Column order is kept, the count comes last."""
    own, tag, spans, news = (column_named(df, c) for c in ("n_entities", "tag", "spans", "news"))
    found = F.coalesce(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.array().cast("array<string>"))
    scanned = save(df.withColumn(spans, found), "scanned")
    dirty = scanned.where(F.size(spans) > 0).withColumn(tag, F.md5(F.col(text).cast("binary")))
    mentions = save(dirty.select(F.col(tag).alias("tag"), F.posexplode(F.col(spans)).alias("i", "e")).distinct(), "mentions")
    # all that follows is worked out once for each distinct string, however often it stands anywhere
    said = save(mentions.select("e").distinct().withColumn("kind", _kind(F.col("e"))), "said")
    parts = save(_parts(said), "parts")
    forms = parts.select("kind", "norm", "said").distinct()
    table = surrogate_map(forms.where("kind not in ('title', 'initial')").select("kind", "norm"), key)
    dressed = save(forms.join(table, ["kind", "norm"], "left").select("kind", "norm", "said", _dressed(F.col("kind"), F.col("said"), F.col("new")).alias("to")), "forms")
    lead = F.when(F.col("kind").rlike("^(title|initial|given|surname)") & (F.col("j") > 0), F.lit(" ")).otherwise(F.lit(""))
    whole = parts.join(dressed, ["kind", "norm", "said"]).groupBy("e").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", F.concat(lead, "to").alias("to")))), lambda p: p["to"]), "").alias("to"))
    lists = mentions.join(save(whole, "surrogates-said"), "e").groupBy(F.col("tag").alias(tag)).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "to"))), lambda p: p["to"]).alias(news))
    pieces = F.split(F.col(text), ANY, -1)
    joined = F.array_join(F.zip_with(pieces, F.col(news), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    clean = scanned.where(F.size(spans) == 0).withColumn(own, F.lit(0)).select(*df.columns, own)
    changed = dirty.join(lists, tag).withColumn(own, F.size(spans)).withColumn(text, joined).select(*df.columns, own)
    return clean.unionByName(changed)
