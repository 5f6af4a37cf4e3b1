"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

One pattern finds candidates; each is validated (card numbers by Luhn, IBANs modulo 97, dates by the calendar, IPv4 by
octet, IPv6 by its groups, social security numbers by their ranges) and replaced by a keyed permutation of the set of valid
values of its own format: separators, length, issuer digit, country code and country stay, check digits are computed anew.
Candidates that do not validate are left alone, as are bare digits without separators that are no card number. A permutation
gives equal values equal pseudonyms in every document and different values different ones, with no table of values and no
shuffle.

One value may be written in several ways, and keeps its pseudonym: a phone number's country code is told by its first
digits, not by a separator; dates are permuted as days, whatever their form; IPv6 groups are written out. A date with
slashes is month first where that is a calendar date, else day first; with points or hyphens it is day first, else month
first. Dates of the second reading are permuted among themselves, so that a pseudonym is read as its value was.

The network has ROUNDS rounds over Z_A x Z_B, alternating, with SHA-256 of key, format, round and other half as round
function, so any domain that factors into two parts is permuted exactly: n digits as 10^(n div 2) by the rest, IPv4 as
2^16 by 2^16, dates of the 400-year Gregorian cycle 1800 to 2199 as 189 by 773 days, social security numbers as 898 areas
by 99 x 9999.

Of an e-mail address the local part is replaced, folded to lower case: letters a-z and digits by such, marks stay; one with
any other character is permuted as the hexadecimal digits of its UTF-8 bytes, which are spelt with 16 accented letters. Its
domain stays.

The key is a parameter: a string, which then is part of the query plan, or a table of one row with a column `key` (read
from where the deployment keeps it), which shows in no plan.

Defined results: a null text stays null with no values found; other columns are ignored; a null doc_id is kept; repeated
rows give repeated rows; very long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773
ASCII36 = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Digits of a local part that is not ASCII.
HEX, ACCENTED = "0123456789abcdef", "àáâãäåæçèéêëìíîï"
#: Country calling codes of one and two digits; all others have three.
CALLING = "[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

#: The formats. Each begins where no digit or letter of the same kind stands before.
FORMATS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f]*[0-9:])(?=[A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}([-/])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9/-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
PATTERN = "|".join(FORMATS.values())


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _powers(base: int, most: int) -> str:
    return "array(" + ",".join(f"{base**i}L" for i in range(most + 1)) + ")"


def _round(key: str, tweak: str, r: str, value: str) -> str:
    return f"cast(conv(substr(sha2(concat_ws(':', {key}, {tweak}, cast({r} as string), cast({value} as string)), 256), 1, 15), 16, 10) as bigint)"


def feistel(a: str, b: str, size_a: str, size_b: str, key: str, tweak: str) -> str:
    """SQL for struct(a, b), the keyed permutation of (a, b) in Z_size_a x Z_size_b."""
    step_a = f"named_struct('a', (s.a + {_round(key, tweak, 'r', 's.b')}) % ({size_a}), 'b', s.b)"
    step_b = f"named_struct('a', s.a, 'b', (s.b + {_round(key, tweak, 'r', 's.a')}) % ({size_b}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('a', coalesce(cast({a} as bigint), 0L), 'b', coalesce(cast({b} as bigint), 0L)), (s, r) -> if(r % 2 = 0, {step_a}, {step_b}))"


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, which is then computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def digits(d: str, key: str, tweak: str) -> str:
    """SQL for a permutation of the digit string d (up to 36 digits) that keeps its length; one digit is permuted by 10 x 1."""
    p = _powers(10, 18)
    half = f"(length({d}) div 2)"
    net = feistel(f"nullif(substr({d}, 1, cast({half} as int)), '')", f"substr({d}, cast({half} as int) + 1)", f"element_at({p}, cast({half} as int) + 1)", f"element_at({p}, cast(length({d}) - {half} as int) + 1)", key, f"concat({tweak}, cast(length({d}) as string))")
    return _let(net, "f", f"concat(if({half} = 0, '', lpad(cast(f.a as string), cast({half} as int), '0')), lpad(cast(f.b as string), cast(length({d}) - {half} as int), '0'))")


def luhn_sum(d: str, doubled: int) -> str:
    """SQL for the Luhn sum of digit string d; doubled: the parity, counted from the right at 0, of the digits doubled."""
    v = f"cast(substr({d}, length({d}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, i) -> t + if(i % 2 = {doubled}, if({v} > 4, {v} * 2 - 9, {v} * 2), {v}))"


def mod97(text: str) -> str:
    """SQL for the number that text's digits and letters (A = 10) spell, modulo 97."""
    c = f"substr({text}, i, 1)"
    return f"aggregate(sequence(1, length({text})), 0, (t, i) -> cast(if({c} between '0' and '9', t * 10 + ascii({c}) - 48, t * 100 + ascii({c}) - 55) % 97 as int))"


def refill(skeleton: str, d: str) -> str:
    """SQL for skeleton with its digits replaced, in order, by the digits of d."""
    c = f"substr({skeleton}, i, 1)"
    return f"aggregate(sequence(1, length({skeleton})), named_struct('o', '', 'k', 1), (s, i) -> if({c} between '0' and '9', named_struct('o', concat(s.o, substr({d}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, {c}), 'k', s.k)), s -> s.o)"


def _letters(text: str, alphabet: str, key: str, tweak: str) -> str:
    """SQL for text with its characters of the alphabet permuted, 20 (or 22) at a time, and all others kept in place."""
    base, chunk = len(alphabet), 20 if len(alphabet) > 40 else 22
    a, p = _quoted(alphabet), _powers(base, chunk // 2)
    number = lambda x: f"aggregate(sequence(1, greatest(length({x}), 1)), 0L, (t, i) -> if(i > length({x}), t, t * {base}L + instr({a}, substr({x}, i, 1)) - 1))"
    spelt = lambda v, n: f"if({n} = 0, '', array_join(transform(sequence({n} - 1, 0, -1), i -> substr({a}, cast(({v} div element_at({p}, cast(i as int) + 1)) % {base} as int) + 1, 1)), ''))"
    half = "(length(g.x) div 2)"
    net = feistel(number(f"substr(g.x, 1, cast({half} as int))"), number(f"substr(g.x, cast({half} as int) + 1)"), f"element_at({p}, cast({half} as int) + 1)", f"element_at({p}, cast(length(g.x) - {half} as int) + 1)", key, f"concat({tweak}, cast(g.n as string), '/', cast(length(g.x) as string))")
    coded = _let(net, "f", f"concat({spelt('f.a', half)}, {spelt('f.b', f'(length(g.x) - {half})')})")
    only = f"array_join(filter(split({text}, ''), c -> instr({a}, c) > 0 and c <> ''), '')"
    parts = f"transform(sequence(0, greatest(length(w) - 1, 0) div {chunk}), n -> named_struct('n', n, 'x', substr(w, cast(n as int) * {chunk} + 1, {chunk})))"
    code = _let(only, "w", f"if(w = '', '', array_join(transform({parts}, g -> {coded}), ''))")
    c = f"substr({text}, i, 1)"
    fill = f"aggregate(sequence(1, length({text})), named_struct('o', '', 'k', 1), (s, i) -> if(instr({a}, {c}) > 0, named_struct('o', concat(s.o, substr(q, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, {c}), 'k', s.k)), s -> s.o)"
    return _let(code, "q", fill)


def _hidden(date_text: str, key: str, same: str) -> str:
    """SQL for the pseudonym of a date, or same where it is none; date_text is split at its mark into three numbers.

    x.q holds the numbers in their order; x.iso whether the year comes first; x.alt whether the second reading holds.
    """
    day = lambda y, m, d: f"datediff(try_cast(concat_ws('-', {y}, lpad({m}, 2, '0'), lpad({d}, 2, '0')) as date), date'{FIRST_DAY}')"
    within = lambda n: f"{n} between 0 and {DAYS_A * DAYS_B - 1}"
    mark = f"regexp_extract({date_text}, '([-/.])', 1)"
    ymd, mdy, dmy = day("q[0]", "q[1]", "q[2]"), day("q[2]", "q[0]", "q[1]"), day("q[2]", "q[1]", "q[0]")
    first = f"case when length(q[0]) = 4 then {ymd} when k = '/' then {mdy} else {dmy} end"
    second = f"case when length(q[0]) = 4 then null when k = '/' then {dmy} else {mdy} end"
    step = lambda n: _let(feistel(f"{n} div {DAYS_B}", f"{n} % {DAYS_B}", f"{DAYS_A}L", f"{DAYS_B}L", key, "'date'"), "f", f"cast(f.a * {DAYS_B} + f.b as int)")
    # A date of the second reading has a day after the 12th, and is permuted until it has one again.
    walked = f"aggregate(sequence(1, 64), {step('n.v')}, (t, i) -> if(day(date_add(date'{FIRST_DAY}', t)) > 12, t, {step('t')}))"
    number = f"if({within('a')}, named_struct('v', a, 'alt', false), if({within('b')}, named_struct('v', b, 'alt', true), null))"
    pad = lambda x, of: f"lpad(cast({x} as string), if(length({of}) = 2, 2, if({x} > 9, 2, 1)), '0')"
    y, month, d = "lpad(cast(year(t) as string), 4, '0')", "month(t)", "day(t)"
    spelt = f"case when length(q[0]) = 4 then concat_ws(k, {y}, {pad(month, 'q[1]')}, {pad(d, 'q[2]')}) when (k = '/') <> n.alt then concat_ws(k, {pad(month, 'q[0]')}, {pad(d, 'q[1]')}, {y}) else concat_ws(k, {pad(d, 'q[0]')}, {pad(month, 'q[1]')}, {y}) end"
    value = _let(f"date_add(date'{FIRST_DAY}', if(n.alt, {walked}, {step('n.v')}))", "t", f"named_struct('kind', 'date', 'value', {spelt})")
    return _let(mark, "k", _let(f"split({date_text}, '[-/.]')", "q", _let(first, "a", _let(second, "b", _let(number, "n", f"if(n is null, {same}, {value})")))))


def _ipv6(text: str, key: str, same: str) -> str:
    """SQL for the pseudonym of an IPv6 address, all eight groups written out: either half is permuted by itself."""
    side = lambda at: f"filter(split(substring_index({text}, '::', {at}), ':'), x -> x <> '')"
    full = f"if(instr({text}, '::') = 0, split({text}, ':'), {_let(side(1), 'u', _let(side(-1), 'v', 'concat(u, array_repeat(' + repr('0') + ', greatest(8 - size(u) - size(v), 0)), v)'))})"
    word = lambda i: f"conv(concat(lpad(g[{i}], 4, '0'), lpad(g[{i + 1}], 4, '0')), 16, 10)"
    half = lambda i: feistel(word(i), word(i + 2), "4294967296L", "4294967296L", key, f"'ipv6/{i}'")
    spell = lambda n: f"lower(hex({n} div 65536)), lower(hex({n} % 65536))"
    done = _let(half(0), "f", _let(half(4), "e", f"named_struct('kind', 'ipv6', 'value', concat_ws(':', {spell('f.a')}, {spell('f.b')}, {spell('e.a')}, {spell('e.b')}))"))
    return _let(full, "g", f"if(size(g) = 8, {done}, {same})")


def pseudonym(m: str, k: str) -> str:
    """SQL for struct(kind, value) of candidate m under the key that k is SQL for: kind null and m itself where m is not valid."""
    full = {n: _quoted(f"^(?:{p})$") for n, p in FORMATS.items()}
    d = f"regexp_replace({m}, '[^0-9]', '')"
    out = lambda kind, value: f"named_struct('kind', {kind}, 'value', {value})"
    same = out("cast(null as string)", m)
    local, domain = f"lower(substring_index({m}, '@', 1))", f"substring_index({m}, '@', -1)"
    coded = _let("lower(hex(encode(l, 'UTF-8')))", "w", f"translate({_letters('w', HEX, k, _quoted('utf8'))}, '{HEX}', '{ACCENTED}')")
    email = out("'email'", f"concat({_let(local, 'l', f'if(l rlike {_quoted("^[ -~]*$")}, {_letters("l", ASCII36, k, "'email'")}, {coded})')}, '@', {domain})")
    octets = f"split({m}, '[.]')"
    ip = out("'ip'", _let(octets, "o", _let(feistel("cast(o[0] as int) * 256 + cast(o[1] as int)", "cast(o[2] as int) * 256 + cast(o[3] as int)", "65536L", "65536L", k, "'ip'"), "f", "concat_ws('.', cast(f.a div 256 as string), cast(f.a % 256 as string), cast(f.b div 256 as string), cast(f.b % 256 as string))")))
    area, low = "cast(substr(d, 1, 3) as int)", "(cast(substr(d, 4, 2) as int) - 1) * 9999 + cast(substr(d, 6) as int) - 1"
    valid_ssn = f"{area} between 1 and 899 and {area} <> 666 and substr(d, 4, 2) <> '00' and substr(d, 6) <> '0000'"
    ssn_net = feistel(f"{area} - if({area} > 666, 2, 1)", low, "898L", "989901L", k, "'ssn'")
    ssn = f"if({valid_ssn}, {out("'ssn'", _let(ssn_net, 'f', refill(m, "concat(lpad(cast(f.a + if(f.a >= 665, 2, 1) as string), 3, '0'), lpad(cast(f.b div 9999 + 1 as string), 2, '0'), lpad(cast(f.b % 9999 + 1 as string), 4, '0'))")))}, {same})"
    code = f"if({m} like '+%', if(d rlike '^({CALLING})', length(regexp_extract(d, '^({CALLING})', 1)), 3), 0)"
    phone = f"if(length(d) between 8 and 15, {out("'phone'", _let(code, 'h', refill(m, f"concat(substr(d, 1, h), {_let('substr(d, h + 1)', 'y', digits('y', k, "concat('phone', substr(d, 1, h), '/')"))})")))}, {same})"
    body = _let("substr(d, 2, length(d) - 2)", "y", f"concat(substr(d, 1, 1), {digits('y', k, "concat('card', substr(d, 1, 1), '/')")})")
    card = f"if({luhn_sum('d', 1)} % 10 = 0, {out("'card'", _let(body, 'p', refill(m, f"concat(p, cast((10 - {luhn_sum('p', 0)} % 10) % 10 as string))")))}, {same})"
    plain = f"replace({m}, ' ', '')"
    account = _let("regexp_replace(substr(u, 5), '[^0-9]', '')", "y", f"if(y = '', u, concat(substr(u, 1, 4), {refill('substr(u, 5)', digits('y', k, "concat('iban', substr(u, 1, 2), '/')"))}))")
    fresh = _let(account, "v", f"concat(substr(v, 1, 2), lpad(cast(98 - {mod97("concat(substr(v, 5), substr(v, 1, 2), '00')")} as string), 2, '0'), substr(v, 5))")
    spaced = "if(instr(" + m + ", ' ') > 0, trim(regexp_replace(z, '(.{4})', '$1 ')), z)"
    iban = _let(plain, "u", f"if({mod97('concat(substr(u, 5), substr(u, 1, 4))')} = 1 and length(u) <= 34, {out("'iban'", _let(fresh, 'z', spaced))}, {same})")
    kinds = (("email", email), ("iban", iban), ("ip", ip), ("ipv6", _ipv6(m, k, same)), ("date", _hidden(m, k, same)), ("ssn", ssn), ("phone", phone), ("card", card))
    cases = " ".join(f"when {m} rlike {full[n]} then {x}" for n, x in kinds)
    return _let(d, "d", f"case {cases} else {same} end")


def pseudonymise(docs: DataFrame, key: str | DataFrame) -> DataFrame:
    """doc_id, text (values replaced), kinds (of each value found, in order of place), n_values."""
    docs, sql = docs.select("doc_id", "text"), "secret"
    if isinstance(key, DataFrame):
        docs = docs.withColumn("secret", key.select(F.col("key").cast("string")).scalar())
    else:
        sql = _quoted(key)
    # Every format has a digit or an @, so texts without are told off by a plain search.
    found = docs.withColumn("found", F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    done = found.select("doc_id", "text", F.expr(f"if(size(found) > 0, transform(found, m -> {pseudonym('m', sql)}), null)").alias("done"), F.when(F.size("found") > 0, F.split("text", PATTERN, -1)).alias("rest"))
    text = F.expr("if(done is null, text, concat(array_join(transform(done, (x, i) -> concat(rest[i], x.value)), ''), element_at(rest, -1)))")
    kinds = F.expr("coalesce(transform(filter(done, x -> x.kind is not null), x -> x.kind), cast(array() as array<string>))")
    return done.select("doc_id", text.alias("text"), kinds.alias("kinds"), F.size(kinds).alias("n_values"))
