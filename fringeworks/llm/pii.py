"""Personal data: detection and surrogates, in column expressions only.

Each entity gets a replacement drawn by a keyed hash of its kind and value: the
same value has the same replacement in every text, characters keep their class
and separators their place, cards keep the standing of their check digit, names
keep gender and script.  One pass collects the distinct values of the corpus and
draws again, with a higher attempt number, where two values share a replacement,
or a replacement is itself a value of the corpus or shows the value it stands for,
until all are distinct.  Later attempts draw from wider spaces (longer local parts,
compound names, more digits), so this ends however crowded a space is.  A second
pass writes the texts; only the few values drawn again need a lookup.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import counted, drop_scratch, materialize

# Given and family names by gender and script.
POOLS: dict[str, list[str]] = {
    "given_m_latn": "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Pierre Hans Carlos Luis Juan Pedro Stefan Jürgen François".split(),
    "given_f_latn": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Claire Sabine Carmen Lucía Ana Isabel Petra Ingrid Amélie".split(),
    "given_n_latn": "Alex Robin Sam Jordan Taylor Casey Morgan Jamie Riley Quinn Avery Rowan Sidney Kim Noa Luca Andrea Sascha Dominique Camille".split(),
    "family_latn": "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Thompson White Harris Clark Lewis Walker Young Allen King Wright Scott Hill Green Adams Baker Nelson Carter Mitchell Roberts Müller Schneider Fischer Weber Dubois Moreau Laurent García Fernández López".split(),
    "given_m_cyrl": "Александр Дмитрий Максим Сергей Андрей Алексей Иван Михаил Николай Павел Пётр Владимир".split(),
    "given_f_cyrl": "Анна Мария Елена Ольга Наталья Татьяна Ирина Екатерина Светлана Юлия Дарья Вера".split(),
    "family_m_cyrl": "Иванов Смирнов Кузнецов Попов Васильев Петров Соколов Михайлов Новиков Фёдоров Морозов Волков".split(),
    "family_f_cyrl": "Иванова Смирнова Кузнецова Попова Васильева Петрова Соколова Михайлова Новикова Фёдорова Морозова Волкова".split(),
}
# Forms of address by gender and script.
TITLES: dict[str, list[str]] = {
    "m_latn": "Mr Mister Herr Monsieur Señor".split(),
    "f_latn": "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita".split(),
    "m_cyrl": "господин г-н".split(),
    "f_cyrl": "госпожа г-жа".split(),
}

_LATN = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?"
_CYRL = r"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?"
_any = lambda *keys: "|".join(x for k in keys for x in k)

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])"
SECRET = r"(?<![0-9A-Za-z])(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?![\d])|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IPV6 = r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}(?![0-9A-Za-z:])"
#: Country, check digits, and groups of four, ten digits among them at least.
IBAN = r"(?=[A-Z]{2}(?:[A-Z ]{0,5}\d){10})[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
#: Keys of services, by their public prefixes.
TOKEN = r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}+|sk-[0-9A-Za-z-]{20,}+|xox[abprs]-[0-9A-Za-z-]{20,}+)(?![0-9A-Za-z])"
CARD = r"(?<![\dA-Za-z.])\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}(?!\d)|(?<![\dA-Za-z.])\d{13,19}(?![\dA-Za-z])"
_titled = lambda titles, name: rf"(?<![\p{{L}}-])(?:{_any(titles)})\.? {name}(?: {name})?"
_given = lambda names, name: rf"(?<![\p{{L}}-])(?:{_any(names)}) {name}"
NAME = "|".join(
    [
        _titled([*TITLES["m_latn"], *TITLES["f_latn"]], _LATN),
        _titled([*TITLES["m_cyrl"], *TITLES["f_cyrl"]], _CYRL),
        _given([*POOLS["given_m_latn"], *POOLS["given_f_latn"]], _LATN),
        _given([*POOLS["given_m_cyrl"], *POOLS["given_f_cyrl"]], _CYRL),
        rf"(?<=name is |[Nn]ame: ){_LATN}(?: {_LATN})?",
    ]
)
#: Entities start a token, with one of these; both checks come before any
#: alternative, so other positions cost two looks at a character class.
_START = r"(?<![0-9A-Za-zÀ-ɏА-яёЁ])(?=[0-9a-f+(A-ZÀ-ÞА-ЯЁгgsx])"
OTHER = rf"{_START}(?:{SECRET}|{IP}|{IPV6}|{PHONE}|{SSN}|{IBAN}|{CARD}|{TOKEN}|{NAME})"
PATTERN = f"{EMAIL}|{OTHER}"
#: A text without any of these holds no entity, so it is not searched further.
_FIRST = _any(*TITLES.values(), *[POOLS[k] for k in POOLS if k.startswith("given")])
HINT = rf"[0-9@]|ame(?: is|:) \p{{Lu}}|(?=[A-ZÀ-ÞА-ЯЁг])(?<![0-9A-Za-zÀ-ɏА-яёЁ])(?:{_FIRST})\.? \p{{Lu}}"
#: Bits of the map that tells which rows may hold a value drawn again.
MAP_BITS = 16
DEFAULT_KEY = "fringeworks"


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(xs: list[str]) -> str:
    return f"array({', '.join(map(_q, xs))})"


def _kind(v: str) -> str:
    return f"""case when instr({v}, '@') > 0 then 'email'
      when {v} rlike '^[0-9A-Fa-f]{{32,}}$' and {v} rlike '[A-Fa-f]' then 'secret'
      when {v} rlike '^\\\\d+[.]\\\\d+[.]\\\\d+[.]\\\\d+$' then 'ip'
      when {v} rlike '^[+(]' or {v} rlike '^\\\\d{{3}}[.-]\\\\d{{3}}[.-]\\\\d{{4}}$' then 'phone'
      when {v} rlike '^\\\\d{{3}}-\\\\d{{2}}-\\\\d{{4}}$' then 'ssn'
      when {v} rlike '^[0-9A-Fa-f]{{1,4}}:' then 'ipv6'
      when {v} rlike '^(AKIA|gh[a-z]_|sk-|xox[a-z]-)' then 'token'
      when {v} rlike '^[A-Z]{{2}}[0-9]' then 'iban'
      when {v} rlike '^[0-9]' then 'card' else 'name' end"""


def _parts(v: str) -> str:
    """array of (kind, value, lead): the parts that get replacements, and the text
    kept before each.  Coreference of names goes by given and family name."""
    words = f"split({v}, ' ')"
    head = f"rtrim('.', element_at({words}, 1))"
    titles = {k: f"array_contains({_array(t)}, {head})" for k, t in TITLES.items()}
    given = {k: f"array_contains({_array(POOLS['given_' + k])}, w)" for k in TITLES}
    first = f"element_at({words}, if({' or '.join(titles.values())}, 2, 1))"
    male = f"({titles['m_latn']} or {titles['m_cyrl']} or (not ({' or '.join(titles.values())}) and exists(array({first}), w -> {given['m_latn']} or {given['m_cyrl']})))"
    female = f"({titles['f_latn']} or {titles['f_cyrl']} or exists(array({first}), w -> {given['f_latn']} or {given['f_cyrl']}))"
    script = f"if({v} rlike '[\\\\u0400-\\\\u04ff]', 'cyrl', 'latn')"
    # A given name of neither list gets one that tells no gender.
    gender = f"case when {male} then 'm' when {female} or {script} = 'cyrl' then 'f' else 'n' end"
    titled = f"({' or '.join(titles.values())})"
    given_kind = f"concat('given_', {gender}, '_', {script})"
    family_kind = f"if({script} = 'cyrl', concat('family_', {gender}, '_cyrl'), 'family_latn')"
    part = lambda kind, value, lead: f"struct({kind} as kind, {value} as value, {lead} as lead)"
    last = f"element_at({words}, -1)"
    title = f"concat(element_at({words}, 1), ' ')"
    name = f"""case when {titled} and size({words}) = 2 then array({part(family_kind, last, title)})
      when {titled} then array({part(given_kind, f"element_at({words}, 2)", title)}, {part(family_kind, last, "' '")})
      when size({words}) = 1 then array({part(given_kind, last, "''")})
      else array({part(given_kind, f"element_at({words}, 1)", "''")}, {part(family_kind, last, "' '")}) end"""
    return f"if({_kind(v)} = 'name', {name}, array({part(_kind(v), v, chr(39) * 2)}))"


def _luhn(digits: str) -> str:
    """Check sum of an array of digits, the last with weight one, modulo 10."""
    doubled = f"transform(reverse({digits}), (d, i) -> if(i % 2 = 1, if(d > 4, 2 * d - 9, 2 * d), d))"
    return f"(aggregate({doubled}, 0, (s, d) -> s + d) % 10)"


def surrogate(kind: str, value: str, attempt: str, key: str) -> str:
    """SQL of the replacement of a part, from SQL of its kind, value and attempt."""
    h = f"sha2(concat_ws('|', {_q(key)}, {kind}, {value}, cast({attempt} as string)), 256)"
    byte = lambda h, i: f"cast(conv(substring({h}, ({i}) % 31 * 2 + 1, 2), 16, 10) as int)"

    def turn(text: str, h: str, hex_only: bool = False) -> str:
        """Each letter and digit replaced within its class, at its place."""
        long = f"cast(conv(substring({h}, (i % 29) * 2 + 1, 6), 16, 10) as int) + 7919 * cast(floor(i / 29) as int)"
        digit = f"chr((ascii(c) - 48 + {long}) % 10 + 48)"
        if hex_only:
            # A letter keeps its place's case; without small letters the whole is in capitals.
            new = f"substring('0123456789abcdef', (instr('0123456789abcdef', lower(c)) - 1 + {long}) % 16 + 1, 1)"
            turned = f"array_join(transform(split({text}, ''), (c, i) -> if(c rlike '[A-F]', upper({new}), {new})), '')"
            return f"element_at(transform(array({turned}), s -> if({text} rlike '[a-f]', s, upper(s))), 1)"
        lower, upper = (f"chr((ascii(c) - {a} + {long}) % 26 + {a})" for a in (97, 65))
        return f"array_join(transform(split({text}, ''), (c, i) -> case when c rlike '[0-9]' then {digit} when c rlike '[a-z]' then {lower} when c rlike '[A-Z]' then {upper} else c end), '')"

    # What widens the space of a value that was drawn again: from the first attempt for
    # addresses, whose local part may leave nothing to vary, later for numbers.
    letters = f"repeat('a', if({attempt} > 0, {attempt} + 1, 0))"
    zeros = f"repeat('0', 2 * greatest(0, {attempt} - 3))"
    domain = f"substring_index({value}, '@', -1)"
    of_domain = f"sha2(concat_ws('|', {_q(key)}, 'domain', lower({domain})), 256)"
    # The domain's labels go by the domain alone; its last is reserved for examples.
    local = f"concat(substring_index({value}, '@', 1), {letters})"
    email = f"concat({turn(local, h)}, '@', {turn(f"substring_index({domain}, '.', size(split({domain}, '[.]')) - 1)", of_domain)}, '.example')"
    # Class E addresses are routed nowhere, and 2001:db8 is for documentation.
    groups = ", ".join(f"substring({h}, {4 * i + 1}, 4)" for i in range(6))
    ipv6 = f"concat_ws(':', '2001', 'db8', {groups})"
    ip = f"if({attempt} > 3, {ipv6}, concat_ws('.', cast(240 + {byte(h, 0)} % 15 as string), cast({byte(h, 1)} as string), cast({byte(h, 2)} as string), cast({byte(h, 3)} as string)))"
    digits = lambda t: f"transform(filter(split({t}, ''), c -> c rlike '[0-9]'), c -> cast(c as int))"
    body = f"concat(substring({value}, 1, 1), {turn(f'concat(substring({value}, 2, length({value}) - 2), {zeros})', h)}, '0')"
    card = f"element_at(transform(array({body}), s -> concat(substring(s, 1, length(s) - 1), cast(pmod({_luhn(digits(value))} - {_luhn(digits('s'))}, 10) as string))), 1)"
    country = f"regexp_extract({value}, '^([+][0-9]{{1,3}}(?=[ .(-])|[+][0-9]{{1,2}}|)', 1)"
    phone = f"concat({country}, {turn(f'concat(substring({value}, length({country}) + 1), {zeros})', h)})"
    ssn = f"concat('9', {turn(f'concat(substring({value}, 2), {zeros})', h)})"
    # Country kept, the account turned, check digits made to fit.
    ninety_seven = lambda t: f"aggregate(split({t}, ''), 0, (r, c) -> case when c rlike '[0-9]' then (r * 10 + ascii(c) - 48) % 97 when c rlike '[A-Z]' then (r * 100 + ascii(c) - 55) % 97 else r end)"
    rest = turn(f"concat(substring({value}, 5), {zeros})", h)
    check = ninety_seven(f"concat(s, substring({value}, 1, 2), '00')")
    iban = f"element_at(transform(array({rest}), s -> concat(substring({value}, 1, 2), lpad(cast(98 - {check} as string), 2, '0'), s)), 1)"
    lead = f"regexp_extract({value}, '^(AKIA|gh[a-z]_|sk-|xox[a-z]-)', 1)"
    token = f"concat({lead}, {turn(f'substring({value}, length({lead}) + 1)', h)})"
    # A redrawn name is a compound of as many names more as it was drawn again.
    pick = lambda p: f"element_at({_array(p)}, cast(conv(substring({h}, i % 15 * 4 + 1, 4), 16, 10) as int) % {len(p)} + 1)"
    names = " ".join(f"when {kind} = {_q(k)} then array_join(transform(sequence(0, cast({attempt} as int)), i -> {pick(p)}), '-')" for k, p in POOLS.items())
    return f"""case {kind} when 'email' then {email} when 'ip' then {ip} when 'ipv6' then {ipv6} when 'card' then {card} when 'phone' then {phone}
      when 'ssn' then {ssn} when 'iban' then {iban} when 'token' then {token} when 'secret' then {turn(value, h, True)} else case {names} end end"""


def _hits(text: str, fn):
    """``fn`` of the pattern that fits the text: addresses are sought only where
    there is an @."""
    return F.when(F.contains(F.col(text), F.lit("@")), fn(PATTERN)).otherwise(fn(OTHER))


def entities(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with _found: the entities of the text in order, as they stand there."""
    found = _hits(text, lambda p: F.regexp_extract_all(F.col(text), F.lit(p), 0))
    return df.withColumn("_found", F.when(F.col(text).rlike(HINT), found).otherwise(F.array().cast("array<string>")))


def redrawn(found: DataFrame, key: str) -> DataFrame | None:
    """(kind, value, attempt) of the values whose first replacement would clash;
    None if there are none.  ``found`` has (kind, value), repeats included.

    All values are drawn once.  After that only those that clash are drawn again, against
    the values of the corpus and the replacements given before.  From the fourth attempt
    each multiplies the possible replacements of a kind by 100 at least (names by
    their pool), so a few more attempts than the logarithm of the number of values do.
    """
    values = materialize(found.distinct(), "pii-values")
    real = values.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real")).hint("merge")
    spent, taken, pending, again, attempt = [values], None, values, [], 0
    while True:
        drawn = pending.select("kind", "value", F.lit(attempt).alias("attempt")).withColumn("surrogate", F.expr(surrogate("kind", "value", "attempt", key)))
        # Of several that drew one replacement the first by hash keeps it.
        keeper = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct(F.xxhash64("value").alias("h"), "value")).alias("keeper"))
        judged = drawn.join(keeper.hint("merge"), ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        clash = (F.col("keeper.value") != F.col("value")) | F.col("real").isNotNull()
        if attempt < 8:  # a long compound of names may well hold a short one
            clash = clash | F.contains(F.lower("surrogate"), F.lower("value"))
        if taken is not None:
            judged = judged.join(taken.withColumn("given", F.lit(True)).hint("merge"), ["kind", "surrogate"], "left")
            clash = clash | F.col("given").isNotNull()
        judged, n = counted(judged.select("kind", "value", "attempt", "surrogate", clash.alias("clash")), "pii-judged", F.col("clash"))
        given = judged.filter("not clash")
        if attempt:
            again.append(given.select("kind", "value", "attempt"))
        else:
            spent.append(judged)
        if not n:
            break
        taken = given.select("kind", "surrogate") if taken is None else taken.union(given.select("kind", "surrogate"))
        pending, attempt = judged.filter("clash"), attempt + 1
    drop_scratch(*spent)
    return reduce(DataFrame.union, again) if again else None


def pseudonymize(docs: DataFrame, key: str = DEFAULT_KEY, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with the entities of ``text_col`` replaced, and their number appended
    as ``count_col`` (a column of that name in ``docs`` is replaced).

    Kinds: e-mail addresses, phone numbers, card and account numbers of 13 to 19
    digits, IBANs, IPv4 and IPv6 addresses, US social security numbers, hexadecimal
    secrets of 32 digits or more in either case, service keys with a public prefix, and
    names after a form of address, after "name is" or "name:", or with a known given
    name.  Null text stays null with 0 entities; texts without entities are unchanged to
    the character.  Repeated rows get the same text; an empty table an empty result.
    """
    # Other columns travel in a struct by position, so their names clash with none here.
    names = [c for c in docs.columns if c.lower() != count_col.lower()]
    other = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text_col])
    plain = docs.select(other.alias("row"), F.col(f"`{text_col}`").alias("text"))
    written = _replaced(plain, key)
    columns = [F.col("text" if c == text_col else f"row.c{i}").alias(c) for i, c in enumerate(names)]
    return written.select(*columns, F.col("n_entities").alias(count_col))


def _replaced(plain: DataFrame, key: str) -> DataFrame:
    """(row, text, n_entities) from (row, text)."""
    found = entities(plain.select("text")).select(F.explode("_found").alias("v"))
    parts = found.select(F.explode(F.expr(_parts("v"))).alias("p")).select("p.kind", "p.value")
    again = redrawn(parts, key)
    marked = entities(plain)
    if again is None:
        return _written(marked, key, "0")
    # Only rows that may hold a value drawn again are looked up; the map has a fixed
    # size, and where it fills up more rows take the way of the lookup.
    maybe = _maybe(again)
    calm = _written(marked.filter(~maybe), key, "0")
    rows = materialize(marked.filter(maybe).withColumn("_row", F.monotonically_increasing_id()), "pii-rows")
    held = rows.select("_row", F.explode("_found").alias("v")).select("_row", F.explode(F.expr(_parts("v"))).alias("p")).select("_row", "p.kind", "p.value").distinct()
    wanted = held.join(again.hint("merge"), ["kind", "value"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "value"), "attempt"))).alias("_again"))
    lookup = "coalesce(element_at(_again, concat_ws('|', p.kind, p.value)), 0)"
    return calm.unionByName(_written(rows.join(wanted, "_row", "left"), key, lookup))


def _slot(kind: str, value: str) -> str:
    return f"pmod(xxhash64({kind}, {value}), {1 << MAP_BITS})"


def _maybe(again: DataFrame):
    slot = again.select(F.expr(_slot("kind", "value")).alias("slot"))
    words = {r["w"]: r["bits"] for r in slot.groupBy(F.expr("cast(slot div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).collect()}
    literal = "array(" + ", ".join(f"{words.get(i, 0)}L" if words.get(i, 0) != -(1 << 63) else "cast(-9223372036854775808 as bigint)" for i in range(1 << MAP_BITS - 6)) + ")"
    slot = _slot("p.kind", "p.value")
    bit = f"getbit(element_at({literal}, cast({slot} div 64 as int) + 1), cast({slot} % 64 as int)) = 1"
    return F.expr(f"exists(_found, v -> exists({_parts('v')}, p -> {bit}))")


def _written(marked: DataFrame, key: str, attempt: str) -> DataFrame:
    """(row, text, n_entities) with the entities in _found replaced."""
    piece = f"concat(p.lead, {surrogate('p.kind', 'p.value', attempt, key)})"
    whole = f"transform(_found, v -> array_join(transform({_parts('v')}, p -> {piece}), ''))"
    between = _hits("text", lambda p: F.split("text", p, -1))
    woven = F.array_join(F.flatten(F.zip_with(between, F.concat(F.expr(whole), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    new = F.when(F.size("_found") > 0, woven).otherwise(F.col("text"))
    return marked.select("row", new.alias("text"), F.greatest(F.size("_found"), F.lit(0)).cast("long").alias("n_entities"))
