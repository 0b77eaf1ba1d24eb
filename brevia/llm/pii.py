"""Personal data: every detected entity gets a keyed surrogate of its own type, with DataFrame operations only.

One regular expression finds all entities of a text once; the text is kept as its matches and the pieces between them, and
put together again with surrogates, so no replacement can touch another. A surrogate is drawn by HMAC from the normalised
entity into the entity's own shape: digits stay digits, letters keep case and script, punctuation stays, names keep their
gender. A name is known by its words alone, whatever its title: each word has one surrogate everywhere, and a document's
names are replaced where they come again without a title. Surrogates of all distinct entities are compared: where two would
share one, or one is itself an entity of the corpus, all but the first draw again, longer if need be, until nothing collides.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import likely, saved

#: Titles that announce a name (fixed values).
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа"]
EITHER = ["Dr", "Prof"]
#: Phrases that announce a name (fixed values).
CUES = ["name is", "Name:", "heiße", "me llamo", "m'appelle", "меня зовут"]
#: Given names: for surrogates, and (but for those of either gender) to find names without a title (fixed values).
GIVEN = {
    "male latin": (
        "Adam Alan Andrew Anthony Arthur Brian Bruno Carl Charles Christopher Daniel David Eric Felix Frank George Henry Hugo Ivan Jack James John Joseph Joshua Karl Kevin Leo Lucas Marco Mark Martin "
        "Matthew Michael Oscar Paul Peter Ralph Richard Robert Simon Steven Thomas Victor Walter William"
    ).split(),
    "female latin": (
        "Ada Alice Amanda Anna Bella Carla Clara Diana Elena Elizabeth Emily Emma Erica Flora Grace Helen Irene Jennifer Jessica Julia Karen Laura Linda Lisa Lucy Margaret Maria Marta Mary Michelle "
        "Nancy Nina Nora Olga Patricia Paula Rebecca Rosa Sara Sarah Sofia Susan Tina Vera"
    ).split(),
    "either latin": "Alex Ari Casey Charlie Dana Devin Drew Eden Jamie Jordan Kai Kim Kit Lee Morgan Noel Pat Quinn Robin Sasha Sam Sky Terry Toni Val".split(),
    "male cyrillic": "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Максим Павел".split(),
    "female cyrillic": "Алла Вера Галина Дарья Елена Ирина Ксения Мария Нина Ольга".split(),
    "either cyrillic": "Женя Валя Саша Слава Шура".split(),
}
#: Syllables of surrogate names, and what ends those of women (fixed values).
SYLLABLES = {"latin": "bar bel dan dor fen gar hal kel lan lor mar mon nor pel ran ros sel tan tor vel wil zan".split(), "cyrillic": "бел вол гор дан зор кал лев мир нов рад сев тор".split()}
ENDING = {"latin": "a", "cyrillic": "а"}


def _any(words: list[str]) -> str:
    """A pattern for any of the words that tests each first letter once."""
    heads = sorted({w[0] for w in words})
    return "(?:" + "|".join(h + "(?:" + "|".join(sorted((w[1:] for w in words if w[0] == h), key=len, reverse=True)) + ")" for h in heads) + ")"


_TITLE = _any(MALE + FEMALE + EITHER)
_LEAD = rf"(?:{_TITLE}\.?|{_any(CUES)})\s"
_KNOWN = _any([n for kind, names in GIVEN.items() if not kind.startswith("either") for n in names])
_EMAIL = r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++){1,10}"
_KEYWORD = r"(?:[Pp](?i:assword|asswd|wd)|[Tt](?i:oken)|[Ss](?i:ecret)|[Aa](?i:pi[_-]?key))"
SECRET = _KEYWORD + r"\\?[\"']?\s?[ \t]*+[=:]\s?[ \t]*+\\?[\"']?"
#: A value goes to its closing quote, or to a blank or a delimiter; signs behind its last letter or digit are left out
#: where 8 others remain. Masks without letters and digits stay.
_VALUE = (
    r"(?:(?<=\")(?=[^\"\r\n]*[\p{L}\p{N}])[^\"\r\n]{7,}[^\"\r\n\\](?=\\?\")|(?<=')(?=[^'\r\n]*[\p{L}\p{N}])[^'\r\n]{7,}[^'\r\n\\](?=\\?')"
    r"|(?=[^\s\"'<>,;&]*[\p{L}\p{N}])(?:[^\s\"'<>,;&]{7,}[\p{L}\p{N}_+/=-]|[^\s\"'<>,;&]{8,}))"
)
_SECRET = SECRET + _VALUE
_END = r"(?![\p{L}\p{N}])"
_CALLED = r"\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}"
#: Phones without + (area codes and exchanges of the North American form begin with 2 to 9; others with 0), then social security numbers.
_NUMBERS = [
    _CALLED, r"[2-9]\d{2}[.-][2-9]\d{2}[.-]\d{4}", r"[2-9]\d{2} [2-9]\d{2}[ .-]\d{4}", r"[2-9]\d{2}[.-][2-9]\d{2} \d{4}", r"[2-9]\d{2}[2-9]\d{6}",
    r"0[1-9]\d{1,3}[ -]\d{3,4}[ -]?\d{3,5}", r"0[1-9](?:[ .]\d{2}){4}", r"(?!000|666|9)\d{3}(?:-(?!00)\d{2}-| (?!00)\d{2} )(?!0000)\d{4}",
]
_PAREN = r"\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}"
#: A number with + and calling code, besides the form with the area code in brackets: 8 to 15 digits.
_ABROAD = rf"\+(?!{_CALLED}{_END})[1-9](?:[ .()/-]{{0,2}}\d){{7,14}}"
#: Card numbers of other than 16 digits count only with a right check digit, and account numbers with right check digits.
_CARD = r"\d{4}(?:(?: \d{4}){3}|(?:-\d{4}){3})|\d{13,19}"
_ACCOUNT = r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: An address of four parts that isn't a version.
_IP = rf"(?<!(?i:version|release|build|rev|ver|v)[ .:]{{0,2}}){_OCTET}(?:\.{_OCTET}){{3}}(?!\.\d)"
_IP6 = r"(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[a-fA-F:]*\d)(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?!:)"
_KEYS = r"(?:AKIA|ASIA)[A-Z0-9]{16}"
_HEX = r"(?=[a-f]*\d)[0-9a-f]{32,128}"
_REST = r"(?:[\p{L}\p{M}]++(?:['’]\p{L}[\p{L}\p{M}]++)?|['’]\p{L}[\p{L}\p{M}]++)"
#: A capitalised word; initials and particles are parts of a name too (fixed values).
_PART = rf"(?!{_TITLE}{_END})\p{{Lu}}{_REST}"
_SMALL = r"(?:(?:\p{Lu}\. ?|(?:van|von|de|der|den|del|della|di|da|dos|du|la|le|al|el|bin|ibn|ter|ten|zu) ){0,4})"
_NAME = rf"(?:{_LEAD}{_SMALL}{_PART}(?:[ -]{_SMALL}{_PART}){{0,5}}|{_KNOWN}(?: \p{{Lu}}\.)? {_SMALL}{_PART}(?:-{_PART})?)"


_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁ"


def _entity(worded: bool, mail: bool) -> str:
    """Every entity begins a word (or is a number in brackets or with +); the sign it may begin with is tested first.

    worded: with secrets, and names behind a phrase, which begin in lower case. mail: with addresses too.
    """
    start = "" if mail else rf"(?=[0-9(+{_UPPER}a-f{'PpTtSsAanhmм' if worded else ''}])"
    return (
        rf"{start}(?<![\p{{L}}\p{{N}}])(?:{_EMAIL + '|' if mail else ''}(?=[0-9A-Z])(?:{_KEYS}|{_ACCOUNT}|{'|'.join(_NUMBERS)}|{_IP}|{_CARD}){_END}|(?=[0-9A-Fa-f])(?:{_HEX}|{_IP6}){_END}"
        rf"{f'|(?=[ptsaPTSA]){_SECRET}' if worded else ''}|(?=[{_UPPER}{'nhmм' if worded else ''}]){_NAME}{_END}|(?:{_PAREN}|{_ABROAD}){_END})"
    )


#: Texts without a digit, an @ or one of these beginnings, and without these words, hold no entity.
_HINT = rf"(?=[0-9@{_UPPER}])(?:[0-9@]|{_KNOWN} |{_TITLE}\.?\s|A[KS]IA)"
_KEYWORDS = ["password", "passwd", "pwd", "token", "secret", "apikey", "api_key", "api-key"]


#: A country's calling code stays as it is.
COUNTRY = r"^\+?\d{1,3}[ .-]?(?=\()|^\+\d{1,3}[ .-](?=\d)|^\+1(?=\d{10}$)"
_WORD = rf"(?<![\p{{L}}\p{{N}}])\p{{Lu}}{_REST}"
_INITIAL = r"(?<![\p{L}\p{N}])\p{Lu}(?=\.)"

#: A private sign that parts matches from the text around them; where a text has it, it is escaped and put back.
_CUT, _ESCAPE = "\ue000", "\ue001"


def _escaped(text: Column) -> Column:
    inside = text.contains(_CUT) | text.contains(_ESCAPE)
    return F.when(inside, F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "\ue002")), F.lit(_CUT), F.lit(_ESCAPE + "\ue003"))).otherwise(text)


def _restored(text: Column) -> Column:
    return F.when(text.contains(_ESCAPE), F.replace(F.replace(text, F.lit(_ESCAPE + "\ue003"), F.lit(_CUT)), F.lit(_ESCAPE + "\ue002"), F.lit(_ESCAPE))).otherwise(text)


def pieces(text: Column, low: Column) -> Column:
    """The text cut at its entities: plain pieces at even places from 0, matches at odd ones; null for a null text.

    low: the text in lower case.
    """
    plain = _escaped(text)
    worded = F.lit(False)
    for word in _KEYWORDS:
        worded |= low.contains(word)
    for cue in CUES:
        worded |= text.contains(cue)
    cut = lambda *forms: F.regexp_replace(plain, _entity(*forms), f"{_CUT}$0{_CUT}")
    marked = F.when(text.contains("@"), cut(True, True)).when(worded, cut(True, False)).when(text.rlike(_HINT), cut(False, False)).otherwise(plain)
    return F.split(marked, _CUT, -1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _check_sum(digits: Column) -> Column:
    """The sum of digits, every second from the right but the last doubled and cast out by nines; 0 modulo 10 is right."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d)


def _account_check(m: Column) -> Column:
    """The remainder modulo 97 of an account number, its first four signs behind the others and letters as 10 to 35."""
    bare = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))), "")
    step = lambda a, c: F.when(c.rlike(r"\d"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step)


def kind_of(m: Column) -> Column:
    """secret, email, name, ip, ip6, number, card, account, code; or null where a match's check digits are wrong."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.rlike(f"^{SECRET}"), "secret").when(m.contains("@"), "email").when(whole(_NAME), "name").when(m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), "ip").when(whole("|".join([*_NUMBERS, _PAREN, _ABROAD])), "number")
        .when(whole(_CARD), F.when((F.length(_digits(m)) == 16) | (_check_sum(_digits(m)) % 10 == 0), "card")).when(whole(_IP6), "ip6").when(whole(_ACCOUNT), F.when(_account_check(m) == 1, "account")).otherwise("code")
    )


def parts(m: Column, kind: Column) -> Column:
    """The identities in a match, as an array of (kind, norm, role): an e-mail address has its domain and its local part,
    a name its words and initials, others are one. The role of a name's word is surname, male, female or either."""
    one = lambda kind, norm, role=F.lit(""): F.struct(kind.alias("kind"), norm.alias("norm"), role.alias("role"))
    bare = F.regexp_replace(m, rf"^{_LEAD}", "")
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")  # noqa: E731  of each word, so that one word has one identity whatever stands beside it
    words = F.regexp_extract_all(bare, F.lit(f"{_WORD}|{_INITIAL}"), F.lit(0))
    full = F.filter(words, lambda w: F.length(w) > 1)
    titled = lambda names: m.rlike(rf"^{_any(names)}\.?\s")
    known = lambda gender: F.array(*[F.lit(n) for kind, names in GIVEN.items() if kind.startswith(gender) for n in names])
    gender = lambda w: F.when(F.array_contains(known("male"), w), "male").when(F.array_contains(known("female"), w), "female").when(titled(MALE), "male").when(titled(FEMALE), "female").otherwise("either")
    word = lambda w: one(F.concat(F.when(F.length(w) == 1, "initial ").otherwise("name "), script(w)), F.translate(F.lower(w), "’", "'"), F.when(w == F.element_at(full, -1), "surname").otherwise(gender(w)))
    domain = F.lower(F.substring_index(m, "@", -1))
    alone = F.when(kind == "secret", F.regexp_replace(m, f"^{SECRET}", "")).when(kind == "number", _digits(F.regexp_replace(m, COUNTRY, ""))).when(kind == "card", _digits(m)).when(kind == "account", F.replace(m, F.lit(" "), F.lit(""))).otherwise(m)
    mail = F.array(one(F.concat(F.lit("mail "), domain), F.lower(F.substring_index(m, "@", 1))), one(F.lit("domain"), domain))
    return F.when(kind == "name", F.transform(words, word)).when(kind == "email", mail).otherwise(F.array(one(F.when(kind == "secret", "code").otherwise(kind), alone)))


def _hash(key: bytes, kind: Column, norm: Column, attempt: Column) -> Column:
    """The 128 hex digits of HMAC-SHA512 over kind, norm and attempt."""
    block = (key if len(key) <= 128 else hashlib.sha512(key).digest()).ljust(128, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), F.encode(F.concat_ws("|", kind, attempt.cast("string"), norm), "utf-8")), 512)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 512)


def _number(h: Column, at: Column | int, digits: int = 2) -> Column:
    return F.conv(F.substr(h, F.lit(at) if isinstance(at, int) else at, F.lit(digits)), 16, 10).cast("int")


def _shaped(norm: Column, h: Column, signs: bool = False) -> Column:
    """norm with every digit and letter drawn anew; hex stays hex, case and script stay, punctuation stays.

    signs: those besides _ + / = - and blanks are drawn anew too.
    """
    hexadecimal = norm.rlike(r"^(?=.*\d)(?=.*[a-f])[0-9a-f:]+$")

    def one(c: Column, i: Column) -> Column:
        n = _number(h, (i * 2) % 126 + 1)
        pick = lambda letters: F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))
        return (
            F.when(c.rlike(r"\d"), F.when(hexadecimal, pick("0123456789abcdef")).otherwise(pick("0123456789")))
            .when(hexadecimal & c.rlike("[a-f]"), pick("0123456789abcdef")).when(c.rlike(r"[\p{Lu}&&\p{IsCyrillic}]"), pick("АБВГДЕЖЗИКЛМНОПРСТУФ")).when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуф"))
            .when(c.rlike(r"\p{Lu}"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz")).when(F.lit(signs) & c.rlike(r"[^_+/=\s-]"), pick("!#$%*?@^~.:")).otherwise(c)
        )

    return F.array_join(F.transform(F.split(norm, ""), one), "")


def surrogate(kind: Column, norm: Column, role: Column, attempt: Column, key: bytes) -> Column:
    """The replacement of one identity, itself normalised. Later attempts may be longer, so that there is always a free one."""
    h = _hash(key, kind, norm, attempt)
    longer = lambda sign, each: F.repeat(F.lit(sign), F.floor(attempt / each).cast("int"))
    label = F.concat(F.substring_index(norm, ".", 1), longer("x", 2))
    domain = F.concat(_shaped(label, h), F.lit("."), F.when(F.size(F.split(norm, r"\.")) > 2, F.lit("example.")).otherwise(""), F.substring_index(norm, ".", -1))
    octet = lambda i: (_number(h, 1 + 4 * i, 4) % 254 + 1).cast("string")
    ip = F.concat_ws(".", *[octet(i) for i in range(4)])
    prefix = F.regexp_extract(norm, "^(?:AKIA|ASIA)", 0)
    code = F.concat(prefix, _shaped(F.concat(F.substr(norm, F.length(prefix) + 1), longer("x", 8)), h, signs=True))
    body = _shaped(F.substr(norm, F.lit(1), F.length(norm) - 1), h)
    card = F.concat(body, F.pmod(-_check_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

    def chosen(lists: dict[str, list[str]], name: Column, at: Column) -> Column:
        """The entry of a named list that a number picks."""
        every = F.create_map(*[x for k, v in lists.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])[name]
        return F.element_at(every, at % F.size(every) + 1)

    inner = _shaped(F.substr(norm, F.lit(5)), h)
    country = F.substr(norm, F.lit(1), F.lit(2))
    account = F.concat(country, F.lpad((98 - _account_check(F.concat(country, F.lit("00"), inner))).cast("string"), 2, "0"), inner)

    script = F.substring_index(kind, " ", -1)
    count = F.when(role == "surname", 3).otherwise(2) + F.floor(attempt / 2).cast("int")
    built = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: chosen(SYLLABLES, script, _number(h, (i * 4) % 120 + 1, 4))), "")
    built = F.concat(built, F.when(role == "female", F.create_map(*[F.lit(x) for pair in ENDING.items() for x in pair])[script]).otherwise(""))
    given = F.lower(chosen(GIVEN, F.concat_ws(" ", role, script), _number(h, 3, 4)))
    name = F.when((role != "surname") & (attempt == 0), given).otherwise(built)
    letter = F.when(script == "latin", F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), _number(h, 1) % 26 + 1, F.lit(1))).otherwise(F.substr(F.lit("абвгдежзиклмнопрстуф"), _number(h, 1) % 20 + 1, F.lit(1)))
    made = F.when(kind.startswith("mail "), _shaped(F.concat(norm, longer("x", 2)), h)).when(kind == "domain", domain).when(kind == "number", _shaped(F.concat(norm, longer("0", 32)), h)).when(kind == "card", card)
    return made.when(kind == "account", account).when(kind == "ip", ip).when(kind == "ip6", _shaped(norm, h)).when(kind.startswith("name "), name).when(kind.startswith("initial "), letter).otherwise(code)


def _refit(m: Column, value: Column) -> Column:
    """The digits of value in the places of m's digits; what is over follows."""
    step = lambda acc, c: F.when(c.rlike(r"\d"), F.struct(F.concat(acc["out"], F.substr(value, acc["n"], F.lit(1))).alias("out"), (acc["n"] + 1).alias("n"))).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["n"].alias("n")))
    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("n")), step, lambda acc: F.concat(acc["out"], F.substr(value, acc["n"])))


def _renamed(text: Column, names: Column, pattern: str) -> Column:
    """text with each word that names (a map from norm to surrogate) knows replaced, in its own case."""
    words = F.split(F.regexp_replace(text, pattern, f"{_CUT}$0{_CUT}"), _CUT, -1)

    def one(w: Column, i: Column) -> Column:
        new = F.element_at(names, F.translate(F.lower(w), "’", "'"))
        return F.when((i % 2 == 1) & new.isNotNull(), F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(new)).otherwise(F.initcap(new))).otherwise(w)

    return F.array_join(F.transform(words, one), "")


def _identities(found: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """(kind, norm, role) as they are seen in matches; (kind, norm, made) of every distinct identity, none colliding."""
    seen = found.select(F.explode("infos").alias("i")).where("i.kind is not null").select(F.explode("i.parts").alias("p")).select("p.kind", "p.norm", "p.role").distinct()
    seen = saved(seen, "pii-seen")
    has = lambda role: F.max(F.col("role") == role)
    role = F.when(has("male") & ~has("female"), "male").when(has("female") & ~has("male"), "female").when(has("male") | has("either"), "either").otherwise(F.max("role"))
    every = saved(seen.groupBy("kind", "norm").agg(role.alias("role")), "pii-identities")
    drawn = lambda df, attempt: df.withColumn("made", surrogate(F.col("kind"), F.col("norm"), F.col("role"), F.lit(attempt), key))
    apart = ~F.col("kind").startswith("initial ")
    settled = saved(drawn(every.where(~apart), 0).select("kind", "norm", "made"), "pii-settled")
    waiting, attempt = saved(drawn(every.where(apart), 0), "pii-drawn"), 0
    while not waiting.isEmpty():
        wanted = waiting.select("kind", "made").distinct()
        taken = settled.select("kind", "made").unionByName(every.select("kind", F.col("norm").alias("made")))
        free = waiting.join(taken.join(wanted, ["kind", "made"], "left_semi").distinct(), ["kind", "made"], "left_anti")
        won = saved(free.groupBy("kind", "made").agg(F.min("norm").alias("norm")).select("kind", "norm", "made"), "pii-won")
        attempt += 1
        lost = waiting.join(won, ["kind", "norm"], "left_anti").select("kind", "norm", "role")
        settled, waiting = settled.unionByName(won), saved(drawn(lost, attempt), "pii-drawn")
    return seen, settled


def pseudonymise(docs: DataFrame, key: str | bytes) -> DataFrame:
    """docs, all columns, with surrogates in ``text``, and n_entities (how many entities were replaced).

    key: the caller's secret; with it the same entities get the same surrogates in any run, without it they can't be told.
    Null and empty texts stay and have 0. Repeated rows change alike, and ids are never read. A text without entities comes
    back as it is. Texts travel only where an entity of theirs had to draw again, or got its gender elsewhere; all others are
    rewritten where they are read. An input column n_entities is replaced.
    """
    if not key:
        raise ValueError("a secret key is needed")
    key = key.encode() if isinstance(key, str) else bytes(key)
    columns = [c for c in docs.columns if c != "n_entities"]
    read = docs.select(F.struct(F.lit(True).alias("_"), *[docs[c] for c in columns if c != "text"]).alias("_row"), docs["text"].alias("text"), F.lower(docs["text"]).alias("low"))
    cut = read.select("_row", F.xxhash64("text").alias("text_hash"), pieces(F.col("text"), F.col("low")).alias("cut"))
    cut = cut.select("_row", "text_hash", F.filter("cut", lambda x, i: i % 2 == 0).alias("plain"), F.filter("cut", lambda x, i: i % 2 == 1).alias("matches"))
    rows = saved(cut, "pii-cut")
    described = F.transform("matches", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    named = F.transform("described", lambda i: F.struct(i["m"].alias("m"), i["kind"].alias("kind"), parts(i["m"], i["kind"]).alias("parts")))
    found = rows.where("size(matches) > 0").select("text_hash", described.alias("described")).select("text_hash", named.alias("infos"))
    found = saved(found, "pii-found")
    seen, settled = _identities(found, key)
    local = surrogate(F.col("kind"), F.col("norm"), F.col("role"), F.lit(0), key)
    other = saved(seen.withColumn("local", local).join(settled, ["kind", "norm"]).where("local <> made").select("kind", "norm", "made").distinct(), "pii-other")

    rows = rows.withColumn("described", described).withColumn("infos", named).drop("described", "matches")
    if other.isEmpty():
        return _rewritten(rows.withColumn("known", F.lit(None).cast("map<string,string>")), key, columns)
    using = found.select("text_hash", F.explode("infos").alias("i")).where("i.kind is not null").select("text_hash", F.explode("i.parts").alias("p")).select("text_hash", "p.kind", "p.norm").distinct()
    known = using.join(other, ["kind", "norm"]).groupBy("text_hash").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "made"))).alias("known"))
    known = saved(known, "pii-known")
    moving = likely(rows, "text_hash", known.select("text_hash")).join(known, "text_hash", "left")
    staying = likely(rows, "text_hash", known.select("text_hash"), others=True).withColumn("known", F.lit(None).cast("map<string,string>"))
    return _rewritten(moving, key, columns).unionByName(_rewritten(staying, key, columns))


def _rewritten(rows: DataFrame, key: bytes, columns: list[str]) -> DataFrame:
    """Rows of (_row, plain, infos, known) with text put together from the plain pieces and the surrogates of the matches."""
    value = lambda p: F.coalesce(F.element_at("known", F.concat_ws("|", p["kind"], p["norm"])), surrogate(p["kind"], p["norm"], p["role"], F.lit(0), key))
    made = F.transform("infos", lambda i: F.struct(i["m"].alias("m"), i["kind"].alias("kind"), F.transform(i["parts"], lambda p: F.struct(p["norm"].alias("norm"), value(p).alias("made"))).alias("parts")))
    entries = F.array_distinct(F.flatten(F.transform(F.filter("made", lambda i: i["kind"] == "name"), lambda i: i["parts"])))
    valued = rows.withColumn("made", F.when(F.size("infos") > 0, made)).withColumn("names", F.map_from_entries(entries))

    def new(i: Column) -> Column:
        m, first = i["m"], i["parts"][0]["made"]
        return (
            F.when(i["kind"].isNull(), m).when(i["kind"] == "name", _renamed(m, F.col("names"), f"{_WORD}|{_INITIAL}")).when(i["kind"] == "email", F.concat(first, F.lit("@"), i["parts"][1]["made"]))
            .when(i["kind"] == "secret", F.concat(F.regexp_extract(m, f"^{SECRET}", 0), first)).when(i["kind"] == "card", _refit(m, first))
            .when((i["kind"] == "account") & m.contains(" "), F.regexp_replace(first, "(.{4})(?=.)", "$1 "))
            .when(i["kind"] == "number", F.concat(F.regexp_extract(m, COUNTRY, 0), _refit(F.regexp_replace(m, COUNTRY, ""), first))).otherwise(first)
        )

    around = F.when(F.size("names") > 0, F.transform("plain", lambda p: _renamed(p, F.col("names"), _WORD))).otherwise(F.col("plain"))
    put = F.array_join(F.flatten(F.zip_with(around, F.transform("made", new), lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    text = _restored(F.when(F.size("infos") > 0, put).otherwise(F.col("plain")[0]))
    n = F.coalesce(F.size(F.filter("made", lambda i: i["kind"].isNotNull())), F.lit(0))
    n = F.when(F.col("made").isNull(), 0).otherwise(n).cast("int")
    return valued.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in columns], n.alias("n_entities"))
