"""Surrogates for personal data and secrets, by DataFrame and SQL functions only.

One pattern finds all entities of a text. Each distinct entity of the corpus
gets a replacement from a keyed hash: of its own kind, script, gender and
format, the same wherever the entity is named, however it is written there.
Replacements that meet another replacement or an original are drawn again, in
rounds over the table of distinct entities, until all differ; a kind whose space
is too small for that gets longer replacements (addresses other networks), so
rounds end. Texts are cut by
the same pattern and joined with the replacements between the cuts; texts
without entities stay as they are.

Kept of an entity: an address's top-level domain, a phone number's country
code, a card's first digit (and a valid check digit if it had one), an IBAN's
country (with valid check digits), the network class of an IP address, a
secret's name and quotes, a person's title. Domains and surnames are entities
of their own, so two addresses at one domain stay at one domain and "Frau
Weber" stays the "Anna Weber" of before.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import looked_up, materialise

KEY = "coffer-surrogates-1"
#: Rounds of drawing again; from WIDEN on replacements get longer with each, so no space is too small.
ROUNDS, WIDEN = 64, 6
#: Texts with entities, and mentions in them, up to which the table of replacements is broadcast (some 100 bytes each).
BROADCAST_ROWS = 100_000

# Given names by script and gender, fixed values. A name is replaced by another of its list.
GIVEN = {
    ("latin", "f"): "Alice Amelie Anna Beatriz Camille Carmen Charlotte Claire Eleanor Elena Emily Emma Hannah Ingrid Isabella Julia Katharina Laura Lucia Maria Olivia Sophie Susan Victoria".split(),
    ("latin", "m"): "Alexander Andreas Antoine Benjamin Carlos Charles Daniel David Diego Edward Fernando François George Heinrich Henry James Jean Johann John Lukas Michael Pierre Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    ("greek", "f"): "Αικατερίνη Βασιλική Γεωργία Ελένη Μαρία Σοφία".split(),
    ("greek", "m"): "Αλέξανδρος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος".split(),
}
# Titles that announce a surname, fixed values.
TITLES = "Mr\\. Mr Mrs\\. Mrs Ms\\. Ms Dr\\. Dr Prof\\. Herr Frau Monsieur Madame Señor Señora Господин Госпожа Κύριος Κυρία".split()
# Syllables of made-up surnames by script, and their endings.
SYLLABLES = {
    "latin": ("bal bran cal cor dal dor fal fen gar gil hal har kel kor lan lin mar mel nor pal per ral ren sal sen tal tor val ver wil".split(), "der dorf ford man mont ner ridge sen son stead ton vale wick wood".split()),
    "cyrillic": ("бар бел вер вол гар гор дар дол жар зар кал кор лан лес мар мел нор пав рат род сав сол тар тем".split(), "енко ин кин ов ский цев".split()),
    "greek": ("βαλ γαρ δελ ζαν καλ κορ λαμ μαρ μελ νικ παλ ραφ σαλ ταρ φιλ χαρ".split(), "άκης ίδης όπουλος άτος ίου".split()),
}

# Letters that stand for a given name, by script.
INITIALS = {"latin": "ABCDEFGHJKLMNPRST", "cyrillic": "АБВГДЕИКЛМНОПРСТ", "greek": "ΑΒΓΔΕΖΚΛΜΝΠΡΣΤ"}

_GIVEN_ANY = "|".join(n for names in GIVEN.values() for n in names)
_SURNAME = r"\p{Lu}[\p{L}'’\-]+"
_TITLE = "(?:" + "|".join(TITLES) + ")"
# Between a given name or title and the surname.
_INITIAL = r"(?:\p{Lu}\.)+"
_PARTICLE = r"(?:von (?:der|dem|den)|von|van (?:der|den|de)|van|de (?:la|las|los)|del|della|de|di|da|dos|du|zur|zum|zu|ter|ten|bin|ibn)"
_INNER = rf"(?:(?:{_INITIAL}|{_PARTICLE})\s{{1,3}})*"
# A name by its shape: two to four capitalised words, and the first no function word.
_CAPITAL = r"\p{Lu}\p{Ll}[\p{L}'’\-]*"
# Words that begin sentences and no names, fixed values.
_NO_NAME = "A|After|All|An|And|As|At|Aus|Bei|But|By|Das|De|Del|Dem|Den|Der|Des|Die|Ein|Eine|El|En|Er|Es|For|From|Für|He|Her|His|How|If|Im|In|It|La|Las|Le|Les|Los|Mit|My|New|No|Of|On|Or|Our|Para|Por|Pour|Que|San|She|Sie|So|That|The|Their|Then|There|These|They|This|To|Un|Una|Und|Une|Von|Was|We|Wenn|What|When|Where|Wie|With|You|Your|Zu"
_WHOLE = rf"(?!(?:{_NO_NAME})\b){_CAPITAL}(?:\s(?:{_INITIAL}|{_PARTICLE}|{_CAPITAL})){{0,2}}\s{_CAPITAL}(?![\p{{L}}\p{{N}}])"
# What stands before or after a person's name, fixed values.
_CUES = "met|named|called|Dear|Hi|Hello|signed|Sincerely,|Regards,|Name:|name is|I am|I'm|Contact:|Author:|Patient:|heiße|heißt|traf|Liebe|Lieber|Ich bin|m'appelle|Cher|Chère|rencontré|me llamo|se llama|Querido|Querida|Estimado|Estimada"
_DOES = "called|calls|said|says|asked|asks|told|wrote|writes|met|lives|lived|works|worked|replied|answered|phoned|emailed|was born|sagte|sagt|fragte|schrieb|traf|wohnt|arbeitet|rief|a dit|dit|demande|écrit|habite|travaille|appelle|dijo|dice|escribió|vive|trabaja|llamó"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

# A word of these, alone or as part of a longer name: access_token, db.password, AWS_SECRET_ACCESS_KEY, clientSecret; not secretary.
_SECRET_NAME = r"(?i:[\p{L}\p{N}_.\-]*(?:password|passwd|pwd|secret|token|api[_\-]?key)(?:[0-9_.\-][\p{L}\p{N}_.\-]*|(?-i:[A-Z][a-z])[\p{L}\p{N}]*)?)"
# Without both quotes. An address stays an address, and the dot or sign that ends a sentence stays outside.
_SECRET_VALUE = r"(?![\"']?[A-Za-z0-9._+\-]+@[A-Za-z0-9\-]+\.[A-Za-z]{2})[\"']?[A-Za-z0-9+/_\-.~!@#$%^*]{7,}[A-Za-z0-9+/_\-~@#$%^*]={0,2}[\"']?"

#: Kind and pattern, in the order in which they are tried at a place.
PATTERNS = [
    ("email", r"[A-Za-z0-9._+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*(?<=\.[A-Za-z]{2,24})"),
    ("ip", rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])"),
    ("card", r"[0-9](?:[ \-]?[0-9]){12,18}(?![\p{L}\p{N}])"),
    ("phone", r"(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .\-]?[0-9]{3,4}[ .\-][0-9]{3,4}(?![\p{L}\p{N}\-])|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![\p{L}\p{N}])"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("key", r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![\p{L}\p{N}])"),
    ("secret", rf"{_SECRET_NAME}[\"']?\s{{0,3}}[=:]\s{{0,3}}(?:\"[^\"\s]{{8,}}\"|'[^'\s]{{8,}}'|{_SECRET_VALUE})"),
    ("name", rf"(?=\p{{Lu}})(?:(?:{_TITLE}\s{{1,3}})?(?:{_GIVEN_ANY})\s{{1,3}}(?:(?:{_GIVEN_ANY}|{_INITIAL}|{_PARTICLE})\s{{1,3}})*{_SURNAME}|{_TITLE}\s{{1,3}}{_INNER}{_SURNAME}(?:\s{{1,3}}{_INNER}{_SURNAME})?)"),
    ("name", rf"(?=\p{{Lu}}\p{{Ll}}[\p{{L}}'’\-]*+\s[\p{{Lu}}vdztbi])(?:(?<=\b(?:{_CUES})\s){_WHOLE}|{_WHOLE}(?:(?=\s(?:{_DOES})\b)|(?=\s?[<(][A-Za-z0-9._+\-]++@)|(?=\s(?:and|und|et|y|&)\s{_WHOLE})))"),
]
#: All of them, where no word, number or address goes on.
ANY = r"(?<![\p{L}\p{N}._+\-@])(?:" + "|".join(p for _, p in PATTERNS) + ")"


def _sql(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: Kinds that are left as they are: numbers that no card can have, and a word said twice.
NO_KINDS = ("number", "words")
_KIND = "CASE " + " ".join(f"WHEN m RLIKE {_sql('^(?:' + p + ')$')} THEN '{k}'" for k, p in PATTERNS) + " ELSE 'name' END"
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_SECRET_HEAD = r"^(.*?[=:]\s{0,3}[\"']?)(.*?)([\"']?)$"
_LAST_WORD = rf"({_SURNAME})$"
_SCRIPT = "CASE WHEN w RLIKE '\\\\p{IsCyrillic}' THEN 'cyrillic' WHEN w RLIKE '\\\\p{IsGreek}' THEN 'greek' ELSE 'latin' END"
#: The entity that a mention names: the same text for all ways to write it.
_CANON = f"""CASE kind
  WHEN 'email' THEN lower(m)
  WHEN 'phone' THEN right({_DIGITS}, 10)
  WHEN 'card' THEN {_DIGITS}
  WHEN 'ssn' THEN {_DIGITS}
  WHEN 'iban' THEN replace(m, ' ', '')
  WHEN 'secret' THEN regexp_extract(m, {_sql(_SECRET_HEAD)}, 2)
  WHEN 'name' THEN lower(regexp_extract(m, {_sql(_LAST_WORD)}, 1))
  ELSE m END"""


def _stream(parts: str, length: str) -> str:
    """SQL of a keyed hex stream with two digits for each of ``length`` characters."""
    return f"array_join(transform(sequence(0, ({length}) div 32), j -> sha2(concat_ws('|', '{{key}}', {parts}, j), 256)), '')"


def _byte(i: str) -> str:
    return f"CAST(conv(substring(ks, 2 * ({i}) - 1, 2), 16, 10) AS int)"


def _pick(chars: str, i: str) -> str:
    return f"substring('{chars}', 1 + {_byte(i)} % {len(chars)}, 1)"


def _like(text: str, may_be_hex: bool = False) -> str:
    """SQL: ``text`` with each ASCII letter and digit replaced by one of its class from the stream ks. ``may_be_hex``: hex digits stay hex digits."""
    c = f"substring({text}, i, 1)"
    hexes = f"WHEN {text} RLIKE '^[0-9a-f]{{8,}}$' AND {text} RLIKE '[a-f]' THEN {_pick('0123456789abcdef', 'i')}" if may_be_hex else ""
    return f"""array_join(transform(sequence(1, length({text})), i -> CASE {hexes}
      WHEN {c} RLIKE '[0-9]' THEN {_pick("0123456789", "i")}
      WHEN {c} RLIKE '[a-z]' THEN {_pick("abcdefghijklmnopqrstuvwxyz", "i")}
      WHEN {c} RLIKE '[A-Z]' THEN {_pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "i")}
      ELSE {c} END), '')"""


#: By how much a replacement is longer than a first draw.
_MORE = f"greatest(0, attempt - {WIDEN - 1})"


def _more(pick: str) -> str:
    """SQL: as many as _MORE of ``pick``, an expression of the place i in the stream, past what the entity itself uses."""
    return f"IF({_MORE} > 0, array_join(transform(sequence(length(canon) + 1, length(canon) + {_MORE}), i -> {pick}), ''), '')"


def _luhn(digits: str, shift: int) -> str:
    """SQL of the Luhn sum; ``shift`` 1 if the check digit is still to come."""
    d = f"CAST(substring({digits}, length({digits}) - i, 1) AS int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (acc, i) -> acc + IF((i + {shift}) % 2 = 0, {d}, IF({d} > 4, 2 * {d} - 9, 2 * {d})))"


def _iban(body: str) -> str:
    """SQL: country || check digits || bban, for country || bban."""
    value = "CASE WHEN c RLIKE '[0-9]' THEN CAST(c AS int) ELSE ascii(c) - 55 END"
    turned = f"concat(substring({body}, 3), substring({body}, 1, 2), '00')"
    rest = f"aggregate(filter(split({turned}, ''), c -> c <> ''), 0, (acc, c) -> (acc * IF(c RLIKE '[0-9]', 10, 100) + {value}) % 97)"
    return f"concat(substring({body}, 1, 2), lpad(CAST(98 - {rest} AS string), 2, '0'), substring({body}, 3))"


def _surname(script: str) -> str:
    body, ends = SYLLABLES[script]
    array = lambda words: "array(" + ", ".join(f"'{w}'" for w in words) + ")"
    syllable = lambda i: f"{array(body)}[{_byte(i)} % {len(body)}]"
    return f"concat({syllable('1')}, {syllable('2')}, IF({_byte('4')} % 2 = 0, {syllable('5')}, ''), {_more(syllable('i'))}, {array(ends)}[{_byte('3')} % {len(ends)}])"


def _address() -> str:
    """SQL: an IPv4 address of the network class of canon; where draws went on, of 10/8, then any, then an IPv6 address for local use."""
    host = f"1 + {_byte('2')} % 254, 1 + {_byte('3')} % 254, 1 + {_byte('4')} % 254"
    return f"""CASE WHEN attempt >= {3 * WIDEN} THEN concat('fd', array_join(transform(sequence(1, 7), i -> lower(substring(ks, 4 * i, 4))), ':'))
      WHEN attempt >= {2 * WIDEN} THEN concat_ws('.', 20 + {_byte('1')} % 80, {host})
      WHEN attempt >= {WIDEN} AND canon RLIKE '^(10|127|192[.]168|172[.](1[6-9]|2[0-9]|3[01]))[.]' THEN concat_ws('.', '10', {host})
      WHEN canon RLIKE '^(10|127)[.]' THEN concat_ws('.', substring_index(canon, '.', 1), {host})
      WHEN canon RLIKE '^192[.]168[.]' THEN concat_ws('.', '192.168', 1 + {_byte('3')} % 254, 1 + {_byte('4')} % 254)
      WHEN canon RLIKE '^172[.](1[6-9]|2[0-9]|3[01])[.]' THEN concat_ws('.', concat('172.', 16 + {_byte('1')} % 16), 1 + {_byte('3')} % 254, 1 + {_byte('4')} % 254)
      ELSE concat_ws('.', 20 + {_byte('1')} % 80, {host}) END"""


def _surrogate(key: str) -> str:
    """SQL of the replacement of an entity (kind, script, canon, and for an address its domain's replacement ``home``) at an attempt."""
    ks = _stream("kind, canon, attempt", f"length(canon) + {_MORE}")
    digit, letter = _pick("0123456789", "i"), _pick("abcdefghijklmnopqrstuvwxyz", "i")
    either = _pick("abcdefghijklmnopqrstuvwxyz0123456789", "i")
    stem = "regexp_replace(canon, '[.][a-z0-9-]+$', '')"
    by_kind = {
        "domain": f"concat({_like(stem)}, {_more(letter)}, substring(canon, length({stem}) + 1))",
        "email": f"concat({_like("substring_index(canon, '@', 1)")}, {_more(letter)}, '@', home)",
        "phone": f"concat(CAST(2 + {_byte('1')} % 8 AS string), substring({_like('canon')}, 2), {_more(digit)})",
        "card": f"concat(substring(canon, 1, 1), substring({_like('canon')}, 2, length(canon) - 2), {_more(digit)})",
        "ssn": f"concat(CAST(1 + {_byte('1')} % 5 AS string), substring({_like('canon')}, 2), {_more(digit)})",
        "ip": _address(),
        "iban": _let(f"concat(substring(canon, 1, 2), substring({_like('canon')}, 5), {_more(digit)})", "body", _iban("body")),
        "key": f"concat(substring(canon, 1, 4), substring({_like('canon')}, 5), {_more(_pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'i'))})",
        "secret": f"concat({_like('canon', True)}, {_more(either)})",
        "name": "CASE script " + " ".join(f"WHEN '{s}' THEN {_surname(s)}" for s in SYLLABLES) + " END",
    }
    made = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in by_kind.items()) + " END"
    checked = f"IF(kind = 'card', concat(x, IF({_luhn('canon', 0)} % 10 = 0, CAST((10 - {_luhn('x', 1)} % 10) % 10 AS string), substring(canon, -1, 1))), x)"
    return _let(ks, "ks", _let(made, "x", checked)).replace("{key}", key.replace("'", ""))


def given_names(key: str) -> dict[str, str]:
    """Each given name's replacement: the next of its list in keyed order, so no two meet and none stays."""
    out = {}
    for (script, gender), names in GIVEN.items():
        turned = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{script}|{gender}|{n}".encode()).digest())
        out |= dict(zip(turned, turned[1:] + turned[:1], strict=True))
    return out


def _pour(chars: str, skip: str = "0") -> str:
    """SQL: the characters of ``sur`` in the places that ``chars`` has in the mention m, after ``skip`` of them; those of a longer ``sur`` at the end."""
    at = f"length(regexp_replace(substring(m, 1, i), '[^{chars}]', ''))"
    all_ = f"length(regexp_replace(m, '[^{chars}]', '')) - ({skip})"
    poured = f"array_join(transform(sequence(1, length(m)), i -> CASE WHEN substring(m, i, 1) RLIKE '[{chars}]' AND {at} > {skip} THEN substring(sur, {at} - ({skip}), 1) ELSE substring(m, i, 1) END), '')"
    return f"concat({poured}, substring(sur, {all_} + 1))"


def _render(key: str) -> str:
    """SQL of a mention m, of some kind, with its entity's replacement ``sur`` written as the mention is."""
    names = "map(" + ", ".join(f"'{a}', '{b}'" for a, b in given_names(key).items()) + ")"
    # Each word of the mention before the surname: given names (listed or not) and initials are replaced, titles, particles and white space stay.
    head = f"regexp_replace(m, {_sql(_LAST_WORD)}, '')"
    keyed = lambda n: f"CAST(conv(substring(sha2(concat('{key.replace(chr(39), '')}|given|', w), 256), 1, 7), 16, 10) AS int) % {n}"
    pick = lambda words: f"array({', '.join(map(_sql, words))})[{keyed(len(words))}]"
    given = "CASE script " + " ".join(f"WHEN '{s}' THEN {pick([n for (of, _), ns in GIVEN.items() if of == s for n in ns])}" for s in SYLLABLES) + " END"
    letters = "CASE script " + " ".join(f"WHEN '{s}' THEN {pick(ls)}" for s, ls in INITIALS.items()) + " END"
    titles = ", ".join(_sql(t.replace("\\", "")) for t in TITLES)
    other = f"CASE WHEN w IN ({titles}) THEN w WHEN w RLIKE {_sql('^' + _INITIAL + '$')} THEN concat({letters}, '.') WHEN w RLIKE {_sql('^' + _SURNAME + '$')} THEN {given} ELSE w END"
    words = f"array_join(transform(split({head}, '(?<=\\\\s)|(?=\\\\s)'), w -> coalesce({names}[w], {other})), '')"
    last = f"regexp_extract(m, {_sql(_LAST_WORD)}, 1)"
    return f"""CASE kind
      WHEN 'phone' THEN {_pour("0-9", "greatest(0, length(" + _DIGITS + ") - 10)")}
      WHEN 'card' THEN {_pour("0-9")}
      WHEN 'ssn' THEN {_pour("0-9")}
      WHEN 'iban' THEN {_pour("0-9A-Z")}
      WHEN 'email' THEN IF(m = upper(m), upper(sur), sur)
      WHEN 'secret' THEN concat(regexp_extract(m, {_sql(_SECRET_HEAD)}, 1), sur, regexp_extract(m, {_sql(_SECRET_HEAD)}, 3))
      WHEN 'name' THEN concat({words}, IF({last} = upper({last}), upper(sur), initcap(sur)))
      WHEN 'number' THEN m
      WHEN 'words' THEN m
      ELSE sur END"""


def mentions(docs: DataFrame) -> DataFrame:
    """The distinct texts of ``docs`` that have entities: text_key (MD5 of the text), found (their mentions in order)."""
    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    return docs.select(F.col("text").cast("string").alias("text")).select(F.md5("text").alias("text_key"), found.alias("found")).where(F.size("found") > 0).dropDuplicates(["text_key"])


def _named(found: DataFrame) -> DataFrame:
    """One row for each mention: text_key, place, m, kind, script, canon, home_of (an address's domain). Kinds of NO_KINDS have the canon ''."""
    rows = found.select("text_key", F.posexplode("found").alias("place", "m")).withColumn("kind", F.expr(_KIND))
    no_card = f"kind = 'card' AND ({_DIGITS} NOT RLIKE '^[2-6]' OR {_luhn(_DIGITS, 0)} % 10 <> 0)"
    rows = rows.withColumn("kind", F.expr(f"CASE WHEN {no_card} THEN 'number' WHEN kind = 'name' AND m RLIKE '^(\\\\p{{L}}+)(\\\\s+\\\\1)+$' THEN 'words' ELSE kind END"))
    rows = rows.withColumn("w", F.expr(f"IF(kind = 'name', regexp_extract(m, {_sql(_LAST_WORD)}, 1), '')"))
    rows = rows.withColumns({"script": F.expr(f"IF(kind = 'name', {_SCRIPT}, '')"), "canon": F.when(F.col("kind").isin(*NO_KINDS), F.lit("")).otherwise(F.expr(_CANON))}).drop("w")
    return rows.withColumn("home_of", F.when(F.col("kind") == "email", F.substring_index("canon", "@", -1)))


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """A replacement ``sur`` for each row of ``entities`` (kind, script, canon; distinct; for addresses also home).

    No two of a kind are alike and none is an entity of that kind. Of those that
    meet, the smallest keeps its draw and the others draw again.
    """
    draw = F.expr(_surrogate(key))
    if "home" not in entities.columns:
        entities = entities.withColumn("home", F.lit(None).cast("string"))
    drawn = materialise(entities.select("kind", "script", "canon", "home").withColumn("attempt", F.lit(0)).withColumn("sur", draw), "pii-draw")
    for attempt in range(1, ROUNDS + 1):
        owners = drawn.groupBy("kind", "sur").agg(F.min("canon").alias("owner"), F.count("*").alias("n"))
        taken = drawn.select("kind", F.col("canon").alias("sur"), F.lit(True).alias("taken"))
        bad = owners.join(taken, ["kind", "sur"], "left").where("n > 1 OR taken").distinct()
        bad = materialise(bad, "pii-met")
        if not bad.take(1):
            return drawn.drop("attempt", "home")
        # A draw that meets an original is never kept, not even by its owner.
        met = drawn.join(bad, ["kind", "sur"], "left")
        met = met.withColumn("again", F.col("owner").isNotNull() & (F.coalesce("taken", F.lit(False)) | (F.col("canon") != F.col("owner"))))
        redrawn = met.withColumn("attempt", F.when(F.col("again"), F.lit(attempt)).otherwise(F.col("attempt")))
        redrawn = redrawn.withColumn("new", F.when(F.col("again"), draw).otherwise(F.col("sur")))
        drawn = materialise(redrawn.select("kind", "script", "canon", "home", "attempt", F.col("new").alias("sur")), "pii-draw")
    raise RuntimeError(f"replacements still meet after {ROUNDS} draws")


def _made(named: DataFrame, key: str) -> DataFrame:
    """kind, script, canon, sur for each entity of ``named``: domains first, then all that may lie in one."""
    entities = materialise(named.where(~F.col("kind").isin(*NO_KINDS)).select("kind", "script", "canon", "home_of").distinct(), "pii-entities")
    domains = entities.where(F.col("home_of").isNotNull()).select(F.lit("domain").alias("kind"), F.lit("").alias("script"), F.col("home_of").alias("canon")).distinct()
    homes = materialise(surrogates(domains, key).select(F.col("canon").alias("home_of"), F.col("sur").alias("home")), "pii-homes")
    addresses = looked_up(entities.where(F.col("home_of").isNotNull()), homes, ["home_of"])
    rest = entities.where(F.col("home_of").isNull()).withColumn("home", F.lit(None).cast("string"))
    columns = ["kind", "script", "canon", "home"]
    return materialise(surrogates(addresses.select(*columns).unionByName(rest.select(*columns)), key), "pii-made")


def replace_pii(docs: DataFrame, key: str = KEY, report: str = "pii") -> DataFrame:
    """``docs`` with the entities in ``text`` replaced; columns and rows as they were, and ``report`` added: an array of (kind, surrogate) in the order of the text.

    A column of that name in the input is replaced. Null and empty texts, and texts
    without entities, stay as they are, with an empty array. Equal texts become
    equal texts. Rows are not matched by doc_id, so null or repeated ids do no
    harm. The same key gives the same replacements for the same corpus.
    """
    found = materialise(mentions(docs), "pii-mentions")
    named = materialise(_named(found), "pii-named")
    made = _made(named, key)
    plain = named.where(F.col("kind").isin(*NO_KINDS)).withColumn("sur", F.lit(""))
    named = named.where(~F.col("kind").isin(*NO_KINDS))
    spoken = looked_up(named, made, ["kind", "script", "canon"]).select(*plain.columns).unionByName(plain)
    spoken = spoken.select("text_key", F.struct("place", "kind", F.expr(_render(key)).alias("surrogate")).alias("p"))
    by_text = spoken.groupBy("text_key").agg(F.sort_array(F.collect_list("p")).alias("spoken"))  # the mentions of one text
    by_text = materialise(by_text.where(F.exists("spoken", lambda p: ~p["kind"].isin(*NO_KINDS))), "pii-by-text")
    size = by_text.agg(F.count("*"), F.sum(F.size("spoken"))).first()
    if max(size[0], size[1] or 0) <= BROADCAST_ROWS:
        by_text = F.broadcast(by_text)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != report]).alias("row"), F.col("text").cast("string").alias("old"))
    joined = whole.withColumn("key", F.md5("old")).join(by_text, F.col("key") == F.col("text_key"), "left")
    gaps = F.split("old", F.lit(ANY), -1)
    woven = F.array_join(F.zip_with(gaps, F.transform("spoken", lambda p: p["surrogate"]), lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit("")))), "")
    fitting = F.when(F.size(gaps) == F.size("spoken") + 1, woven).otherwise(F.raise_error(F.lit("mentions and replacements differ in number")))
    joined = joined.withColumn("new", F.when(F.col("spoken").isNull(), F.col("old")).otherwise(fitting))
    kept = [F.col("new").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c != report]
    entities = F.filter(F.coalesce("spoken", F.array()), lambda p: ~p["kind"].isin(*NO_KINDS))
    return joined.select(*kept, F.transform(entities, lambda p: F.struct(p["kind"].alias("kind"), p["surrogate"].alias("surrogate"))).alias(report))


def replaced_documents(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text (with replacements), n_entities, kinds and surrogates of each row of ``docs``."""
    out = replace_pii(docs.select("doc_id", "text"), key)
    pick = lambda name: F.transform("pii", lambda p: p[name])
    return out.select("doc_id", "text", F.size("pii").alias("n_entities"), pick("kind").alias("kinds"), pick("surrogate").alias("surrogates"))
