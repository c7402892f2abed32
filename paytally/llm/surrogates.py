r"""PII: keyed surrogates for detected entities, with DataFrame functions only.

One pattern finds e-mail addresses, IPv4 addresses, IBANs, card numbers, phone numbers, social security
numbers, credentials and titled person names. Every entity is replaced by a value of its own type and
format, derived with SHA-256 from a key and the entity's canonical form: character classes, letter case,
punctuation, country code, octet widths, the issuer digit and Luhn validity of cards, reserved mail domains,
hex alphabets, the title (gender) and the script of names are kept. Equal entities get equal surrogates in all
documents and spellings (coreference). A check over all distinct entities keeps them apart: of entities with
one surrogate all but the first draw again, as does any whose surrogate is itself an entity of the corpus.

Expressions are built as columns: as SQL text they were so long that what the parser learnt from them stayed
in the driver's memory.

Only entities that drew again need a lookup; they are few. Up to ``max_inline`` of them travel as one map,
beyond that they are joined to their documents. Texts are not shuffled otherwise.

Defined results: null text stays null and empty stays empty; a text without entities is unchanged; repeated
rows are rewritten alike; entities and texts may be of any length, at a cost in proportion; an empty
table gives an empty table; other columns are carried along unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paytally.llm.common import stored

# Titles by gender and script, given names by gender and script, name syllables by script.
TITLES = {
    ("m", "latin"): ["Mr", "Herr", "Señor", "Monsieur"],
    ("f", "latin"): ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame"],
    ("m", "cyrillic"): ["г-н", "Г-н", "господин", "Господин"],
    ("f", "cyrillic"): ["г-жа", "Г-жа", "госпожа", "Госпожа"],
    ("m", "greek"): ["Κύριος", "κύριος"],
    ("f", "greek"): ["Κυρία", "κυρία"],
}
GIVEN = {
    ("m", "latin"): ["Adam", "Boris", "Carlo", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Nils", "Oscar", "Paul"],
    ("f", "latin"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Мария", "Ольга"],
    ("m", "greek"): ["Άρης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Φώτης"],
    ("f", "greek"): ["Άννα", "Βασιλική", "Δήμητρα", "Ελένη", "Ζωή", "Μαρία", "Σοφία", "Χριστίνα"],
}
SYLLABLES = {
    "latin": ["ba", "bel", "bor", "da", "del", "dor", "fa", "fen", "gar", "gol", "ha", "hol", "ka", "kel", "kor", "la", "len", "lor", "ma", "mel", "mor", "na", "nel", "nor", "pa", "pel", "ra", "rel", "sa", "sen", "ta", "tor"],
    "cyrillic": ["ба", "вер", "гор", "да", "жел", "зор", "ка", "лен", "мор", "на", "пел", "рос", "са", "тер", "фа", "хол"],
    "greek": ["βα", "γε", "δο", "ζα", "κα", "λε", "μο", "να", "πα", "ρε", "σο", "τα", "φα", "χε", "ψα", "ρο"],
}
SCRIPT_TEST = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}

_ALL_TITLES = "|".join(t for ts in TITLES.values() for t in ts)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: The alternatives in the order in which they are tried.
KINDS = {
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+-]{8,}|AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|[0-9a-f]{32,}(?![0-9A-Za-z])",
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?:\d{4}[ -]){3}\d{1,7}(?![0-9A-Za-z])|\d{13,19}(?![0-9A-Za-z])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,5}\)|\d{1,5})(?:[ .-]?\d{2,5}){1,4}(?![0-9A-Za-z])|\(\d{3}\) ?\d{3}[-. ]\d{4}(?![0-9A-Za-z])|\d{3}[-.]\d{3}[-.]\d{4}(?![0-9A-Za-z])",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![0-9A-Za-z])",
    "name": rf"(?:{_ALL_TITLES})\.? \p{{Lu}}[\p{{L}}'’-]*\p{{L}}(?: \p{{Lu}}[\p{{L}}'’-]*\p{{L}})?",
}
PATTERN = r"(?<![\p{L}0-9._%+-])(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
#: A text without any of these has no entity; spares the long pattern most texts.
HINT = rf"[0-9@]|(?i:password|passwd|pwd|secret|token|key)|(?:{_ALL_TITLES})[. ]"


def _case(value: Column, results: dict[str, Column], otherwise: Column | str) -> Column:
    """The result whose key equals ``value``, which is computed once."""
    def chosen(x: Column) -> Column:
        out = F
        for k, result in results.items():
            out = out.when(x == k, result)
        return out.otherwise(otherwise)

    return _let(value, chosen)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), lambda x: body(x))[0]


def _substr(v: Column, start: Column | int, length: Column | int | None = None) -> Column:
    return F.substr(v, _lit(start), None if length is None else _lit(length))


def _lit(v: Column | int) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _concat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _kind(m: Column) -> Column:
    out = F
    for k, p in KINDS.items():
        out = out.when(F.regexp_extract(m, f"^(?:{p})$", 0) == m, k)
    return out.otherwise("name")


def _alnum(v: Column) -> Column:
    return F.regexp_replace(v, "[^A-Za-z0-9]", "")


def _canonical(kind: str, v: Column) -> Column:
    """The form in which spellings of one entity agree; itself a valid spelling. Names: see _name_words."""
    if kind == "email":
        return F.lower(v)
    if kind == "secret":
        return F.regexp_replace(v, SECRET_HEAD, "")
    if kind == "phone":
        return F.concat(_phone_head(v), _alnum(_phone_tail(v)))
    return _alnum(v) if kind in ("iban", "card") else v


SECRET_HEAD = r"^(?i:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?"


def _phone_head(v: Column) -> Column:
    """Country code with its plus and one blank; the first digit if nothing marks where the code ends."""
    code = F.regexp_extract(v, r"^(\+\d{1,3}(?=[ .(-])|\+\d)", 1)
    return F.when(_substr(v, 1, 1) == "+", _concat(code, " ")).otherwise("")


def _phone_tail(v: Column) -> Column:
    return _substr(v, F.length(F.rtrim(_phone_head(v))) + 1)


def _stream(key: str, salt: Column) -> Column:
    """256 hex digits drawn from the key and ``salt``."""
    return F.concat(*[F.sha2(_concat(key, f":{i}:", salt), 256) for i in range(4)])


def _number(h: Column, at: Column | int, digits: int = 4) -> Column:
    return F.conv(_substr(h, _lit(at) * digits % (256 - 256 % digits) + 1, digits), 16, 10).cast("bigint")


def _letters(v: Column, h: Column, letters: int = 26) -> Column:
    """Replace letters and digits of ``v`` within their class; the i-th of them takes the i-th number of ``h``,
    so punctuation does not shift the numbers."""
    def drawn(c: Column, n: Column) -> Column:
        return (F.when(c.between("0", "9"), (n % 10).cast("string"))
                .when(c.between("a", "z"), F.char(97 + n % letters)).otherwise(F.char(65 + n % letters)))

    plain = F.array_join(F.transform(_chars(_alnum(v)), lambda c, k: _let(_number(h, k + 1, 2), lambda n: drawn(c, n))), "")
    return _relayout(v, plain)


def _chars(v: Column) -> Column:
    """Array of the characters of an entity (ASCII, but for names)."""
    return F.filter(F.split(v, ""), lambda c: c != "")


def _luhn(d: Column, from_end: int) -> Column:
    """Luhn sum of a digit string; ``from_end`` 0 if its last digit is the check digit, 1 if that is missing."""
    def add(t: Column, i: Column) -> Column:
        x = _substr(d, F.length(d) - i, 1).cast("int")
        return t + F.when((i + from_end) % 2 == 0, x).when(x < 5, 2 * x).otherwise(2 * x - 9)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)


def _relayout(v: Column, plain: Column) -> Column:
    """Put the characters of ``plain`` in the places of the letters and digits of ``v``.

    Both are taken apart once and put together by one sort of positions, so a long entity costs no more
    per character than a short one.
    """
    def mixed(cs: Column, ps: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(cs) - 1)
        put = F.transform(F.filter(places, lambda i: cs[i].rlike("[A-Za-z0-9]")),
                          lambda i, k: F.struct(i.alias("i"), ps[k].alias("c")))
        stay = F.transform(F.filter(places, lambda i: ~cs[i].rlike("[A-Za-z0-9]")),
                           lambda i: F.struct(i.alias("i"), cs[i].alias("c")))
        return F.array_join(F.transform(F.sort_array(F.concat(put, stay)), lambda x: x["c"]), "")

    def placed(p: Column) -> Column:
        apart = _let(_chars(v), lambda cs: _let(_chars(p), lambda ps: mixed(cs, ps)))
        return F.when(F.length(_alnum(v)) == F.length(v), p).otherwise(apart)

    return _let(plain, placed)


def _surrogate(key: str, kind: str, v: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of the spelling ``v`` of an entity that is not a name.

    A format with more entities than values would draw for ever; from the 21st draw on the surrogate
    grows by two characters a draw.
    """
    h = F.sha2(_concat(key, f":more:{kind}:", canon, ":", attempt), 512)
    more = F.when(attempt > 20, _substr(h, 1, 2 * (attempt - 20))).otherwise("")
    return F.concat(_let(_stream(key, _concat(f"{kind}:", canon, ":", attempt)),
                         lambda h: _same_format(key, kind, v, h, attempt)), more)


def _same_format(key: str, kind: str, v: Column, h: Column, attempt: Column) -> Column:
    if kind == "email":
        domain = F.substring_index(v, "@", -1)
        labels = F.split(domain, "[.]")

        def mail(dh: Column) -> Column:
            new = F.transform(F.slice(labels, 1, F.size(labels) - 1),
                              lambda d: F.when(F.lower(d) == "example", d).otherwise(_letters(d, dh)))
            return _concat(_letters(F.substring_index(v, "@", 1), h), "@", F.array_join(new, "."), ".",
                           F.substring_index(domain, ".", -1))

        return _let(_stream(key, _concat("domain:", F.lower(domain))), mail)
    if kind == "secret":
        head = F.regexp_extract(v, SECRET_HEAD, 0)
        return _let(F.regexp_replace(v, SECRET_HEAD, ""), lambda w: F.concat(
            head, F.when(w.rlike("^[0-9a-f]+$"), _letters(w, h, 6))
            .when(w.rlike("^AKIA[0-9A-Z]+$"), _concat("AKIA", _letters(_substr(w, 5), h))).otherwise(_letters(w, h))))
    if kind == "ip":
        def octet(o: Column, n: Column) -> Column:
            # After 20 draws narrow octets may run out; they then widen to three digits.
            return (F.when((F.length(o) == 1) & (attempt <= 20), 1 + n % 9)
                    .when((F.length(o) == 2) & (attempt <= 20), 10 + n % 90).otherwise(100 + n % 155))

        return F.array_join(F.transform(F.split(v, "[.]"), lambda o, i: _let(
            _number(h, i, 4), lambda n: octet(o, n).cast("string"))), ".")
    if kind == "card":
        def card(d: Column) -> Column:
            body = F.concat(_substr(d, 1, 1), _letters(_substr(d, 2, F.length(d) - 2), h))
            return _let(body, lambda b: F.concat(b, F.when(_luhn(d, 0) % 10 == 0, (10 - _luhn(b, 1) % 10) % 10).otherwise(
                _number(h, 40, 2) % 10).cast("string")))

        return _let(_alnum(v), lambda d: _relayout(v, card(d)))
    if kind == "iban":
        return F.concat(_substr(v, 1, 2), _letters(_substr(v, 3), h))
    if kind == "phone":
        return F.concat(_substr(v, 1, F.length(F.rtrim(_phone_head(v)))), _letters(_phone_tail(v), h))
    return _letters(v, h)


def _script(w: Column) -> Column:
    return F.when(w.rlike(SCRIPT_TEST["cyrillic"]), "cyrillic").when(w.rlike(SCRIPT_TEST["greek"]), "greek").otherwise("latin")


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _name_word(key: str, kind: Column, w: Column, attempt: Column) -> Column:
    """Surrogate of one name word; kind: 'given m', 'given f' or 'surname'. A given name that draws again gets
    a syllable more, and surnames grow every second draw, so that names cannot run out."""
    syllables = F.when(kind == "surname", 3 + F.shiftright(attempt, 1)).otherwise(attempt)

    def in_script(s: str, h: Column) -> Column:
        given = F.when(kind == "given m", _array(GIVEN[("m", s)])).when(kind == "given f", _array(GIVEN[("f", s)])).otherwise(
            _array([""]))
        more = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.when(i <= syllables, F.element_at(
            _array(SYLLABLES[s]), (1 + _number(h, i) % len(SYLLABLES[s])).cast("int"))).otherwise(""))
        return F.concat(_let(given, lambda g: F.element_at(g, (1 + _number(h, 0) % F.size(g)).cast("int"))),
                        F.array_join(more, ""))

    def cased(x: Column) -> Column:
        return F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(x)).otherwise(
            F.concat(F.upper(_substr(x, 1, 1)), F.lower(_substr(x, 2))))

    return _let(_stream(key, _concat(kind, ":", F.lower(w), ":", attempt)), lambda h: _let(
        _case(_script(w), {s: in_script(s, h) for s in SYLLABLES}, F.lit(None)), cased))


def _name_words(m: Column) -> Column:
    """Array of (kind, word) of a titled name: given name and surname, or the surname alone."""
    female = "|".join(t for (g, _), ts in TITLES.items() if g == "f" for t in ts)
    words = F.split(F.regexp_replace(m, rf"^(?:{_ALL_TITLES})\.? ", ""), " ")
    given = F.when(m.rlike(f"^(?:{female})"), "given f").otherwise("given m")
    return F.transform(words, lambda w, i: F.struct(
        F.when((F.size(words) == 2) & (i == 0), given).otherwise("surname").alias("kind"), w.alias("word")))


def _entities(m: Column) -> Column:
    """Array of (kind, canon) of one match."""
    others = {k: F.array(F.struct(F.lit(k).alias("kind"), _canonical(k, m).alias("canon"))) for k in KINDS if k != "name"}
    return _case(_kind(m), others, F.transform(
        _name_words(m), lambda w: F.struct(w["kind"].alias("kind"), F.lower(w["word"]).alias("canon"))))


def _replaced(key: str, m: Column, attempts: Column) -> Column:
    def attempt(kind: Column | str, canon: Column) -> Column:
        return F.coalesce(F.try_element_at(attempts, _concat(kind, ":", canon)), F.lit(0))

    def other(kind: str) -> Column:
        return _let(_canonical(kind, m), lambda cn: _let(attempt(kind, cn), lambda a: _surrogate(key, kind, m, cn, a)))

    def name(w: Column) -> Column:
        return _let(attempt(w["kind"], F.lower(w["word"])), lambda a: _name_word(key, w["kind"], w["word"], a))

    title = F.regexp_extract(m, rf"^(?:{_ALL_TITLES})\.? ", 0)
    words = F.array_join(F.transform(_name_words(m), name), " ")
    return _case(_kind(m), {k: other(k) for k in KINDS if k != "name"}, F.concat(title, words))


def _matches(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt, surrogate) for distinct entities, distinct within a kind and none an entity itself.

    Those that collide draw again until none does; surrogates of short formats grow in the end, so
    there are always enough.
    """
    kind, canon, attempt = F.col("kind"), F.col("canon"), F.col("attempt")
    others = {k: _surrogate(key, k, canon, canon, attempt) for k in KINDS if k != "name"}
    surrogate = _case(kind, others, F.lower(_name_word(key, kind, canon, attempt)))

    def drawn(rows: DataFrame) -> DataFrame:
        return stored(rows.withColumn("surrogate", surrogate))

    current = drawn(entities.withColumn("attempt", F.lit(0)))
    taken = entities.select("kind", F.col("canon").alias("surrogate"))
    while True:
        first = current.groupBy("kind", "surrogate").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "canon")).alias("low"))
        twice = first.filter("n > 1").select("kind", "surrogate", "low.canon")
        again = current.join(twice.select("kind", "surrogate", F.col("canon").alias("keeps")), ["kind", "surrogate"]).filter(
            "canon != keeps").select("kind", "canon")
        again = stored(again.union(current.join(taken, ["kind", "surrogate"], "left_semi").select("kind", "canon")).distinct())
        if again.isEmpty():
            return current
        moved = current.join(again.withColumn("_again", F.lit(1)), ["kind", "canon"], "left")
        current = drawn(moved.select("kind", "canon", (F.col("attempt") + F.coalesce("_again", F.lit(0))).alias("attempt")))


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text",
                max_inline: int = 5_000) -> DataFrame:
    """``docs`` with its text rewritten, and nothing else changed."""
    return _rewrite(docs, key, id_col, text_col, max_inline).select(
        *[F.col(f"_t.`{c}`") for c in docs.columns])


def report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_entities and kinds per row."""
    return _rewrite(docs.select(id_col, text_col), key, id_col, text_col, 5_000).select(
        F.col(f"_t.`{id_col}`").alias("doc_id"), F.col(f"_t.`{text_col}`").alias("text"),
        "_n_entities", "_kinds").withColumnsRenamed({"_n_entities": "n_entities", "_kinds": "kinds"})


def _rewrite(docs: DataFrame, key: str, id_col: str, text_col: str, max_inline: int) -> DataFrame:
    # Attempts are looked up by text: rows without an id, or of one id, are not gathered.
    base = docs.select(F.sha2(F.col(f"`{text_col}`").cast("string"), 256).alias("_id"),
                       F.col(f"`{text_col}`").cast("string").alias("_text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    found = base.select("_id", F.explode(_matches(F.col("_text"))).alias("m")).select(
        "_id", F.explode(_entities(F.col("m"))).alias("e"))
    entities = stored(found.select("e.kind", "e.canon").distinct())
    again = assign(entities, key).filter("attempt > 0").select(F.concat_ws(":", "kind", "canon").alias("k"), "attempt")
    many = again.count()
    none = F.expr("cast(map() as map<string, int>)")
    if not many:
        base = base.withColumn("_attempts", none)
    elif many <= max_inline:
        lookup = again.agg(F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("_attempts"))
        base = base.crossJoin(F.broadcast(lookup))  # one row of at most max_inline entries
    else:
        own = found.select("_id", F.concat_ws(":", "e.kind", "e.canon").alias("k")).distinct().join(again, "k")
        own = own.groupBy(F.col("_id").alias("_own")).agg(
            F.map_from_entries(F.collect_list(F.struct("k", "attempt"))).alias("_found"))
        base = base.join(own, F.col("_id").eqNullSafe(F.col("_own")), "left").withColumn(
            "_attempts", F.coalesce("_found", none))
    m, attempts = F.col("_m"), F.col("_attempts")
    text = _let(F.split("_text", PATTERN, -1), lambda p: F.concat(F.array_join(F.transform(
        m, lambda x, j: F.concat(p[j], _replaced(key, x, attempts))), ""), p[F.size(m)]))
    rows = base.withColumn("_m", _matches(F.col("_text"))).withColumn(
        "_new", F.when(F.size(m) > 0, text).otherwise(F.col("_text")))
    return rows.select(
        F.struct(*[F.col("_new").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c)
                   for c in docs.columns]).alias("_t"),
        F.coalesce(F.size("_m"), F.lit(0)).cast("long").alias("_n_entities"),
        F.when(F.size(m) > 0, F.array_sort(F.array_distinct(F.transform(m, _kind)))).otherwise(
            F.array().cast("array<string>")).alias("_kinds"))
