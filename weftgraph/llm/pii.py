"""Surrogates for personal data: keyed, type-consistent, format-preserving, distinct and coreferent. Native SQL functions only."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Given names that are detected before a surname, by gender and script.
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Camille Carmen Claire Elena Emma Ingrid Isabel Julia Karen Linda Lucia Maria Marie Mary Nora Patricia Petra Sarah Sofia Susan".split(),
    ("m", "latin"): "Antonio Carlos Daniel David Francois Hans Henri James John Jose Juan Karl Klaus Louis Michael Miguel Paul Peter Pierre Richard Robert Thomas William".split(),
    ("f", "cyrillic"): "Анна Елена Ирина Мария Наталья Ольга Светлана".split(),
    ("m", "cyrillic"): "Алексей Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("f", "greek"): "Άννα Ειρήνη Ελένη Κατερίνα Μαρία".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Ιωάννης Κώστας Νίκος".split(),
}

#: Given names that stand in for those, of the same gender and script; none is in both.
STAND_IN = {
    ("f", "latin"): "Adela Agatha Beatrix Celeste Daphne Edith Fiona Gerda Hedwig Ilona Josefa Katinka Leonora Mathilda Nadine Odette Paloma Quirina Rosalind Sidonia Tabea Ursula Viola Wilma Xenia Yvette Zelda".split(),
    ("m", "latin"): "Ambrose Basil Conrad Dorian Egon Fabian Gideon Horace Ignaz Jasper Kaspar Leander Magnus Norbert Orson Percy Quentin Ruben Silas Tobias Ulrich Valentin Wendel Xaver Yorick Zeno Anselm".split(),
    ("f", "cyrillic"): "Агата Варвара Дарья Зинаида Клавдия Лидия Марфа Нина Полина Раиса".split(),
    ("m", "cyrillic"): "Архип Богдан Виктор Глеб Ефим Захар Игнат Кирилл Лев Матвей".split(),
    ("f", "greek"): "Ασπασία Δάφνη Ευγενία Θάλεια Ιοκάστη Καλλιόπη Λητώ".split(),
    ("m", "greek"): "Άγις Βασίλης Ευάγγελος Ηλίας Θωμάς Λέανδρος Στέφανος".split(),
}

#: Forms of address that precede a name, and phrases that introduce one.
TITLES = r"Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señora|Señor|Sra|Sr|Г-жа|Г-н|Κυρία|Κύριος"
INTRODUCED = r"[Mm]y name is|[Ii]ch hei(?:ß|ss)e|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es|[Мм]еня зовут|[Μμ]ε λένε|(?:Full n|N)ame:|Contact:|Signed:"
#: Endings of surnames that tell gender; they stay.
ENDINGS = r"(?:ова|ева|ёва|ина|ына|ская|цкая|ов|ев|ёв|ин|ын|ский|цкий|ίδης|ίδου|όπουλος|οπούλου|άκης|άκη)$"

_names = "|".join(n for names in GIVEN.values() for n in names)
_lead = rf"(?:(?:{TITLES})\.?|{INTRODUCED}) "
_more = r"(?:['’-]\p{L}[\p{L}\p{M}]*+)*+"
#: A capitalised word, or a short one of a script without case.
_word_of_name = rf"(?:\p{{Lu}}[\p{{L}}\p{{M}}]++|\p{{Lo}}[\p{{Lo}}\p{{M}}]{{0,11}}+){_more}"
_octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

#: Types in order of preference; each alternative starts where no ASCII letter, digit or underscore precedes.
KINDS = {
    "secret": r"""(?=[A-Za-z])(?i:token|password|passwd|pwd|secret|api[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}["']?(?=[_+/\-]{0,80}+[A-Za-z0-9])[A-Za-z0-9_+/\-]{6,}+""",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "key": r"(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])",
    "iban": r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "card": r"\d{4}(?:[ -]?\d{4}){3}(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<!\d\.)(?:{_octet}\.){{3}}{_octet}(?!\.?\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)",
    "name": rf"(?=[\p{{Lu}}mijмμ])(?:{_lead}{_word_of_name}(?: {_word_of_name})?+|(?:{_names}) \p{{Lu}}[\p{{L}}\p{{M}}]++{_more})",
}
PATTERN = r"(?<![A-Za-z0-9_])(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"

#: Sets of ASCII alphabets; a character may become any of its own alphabet.
SETS = {
    "plain": ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ"],
    "hex": ["0123456789abcdef"],
    "HEX": ["0123456789ABCDEF"],
    "upper": ["0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"],
    "iban": ["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"],
}


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def kind(m: Column) -> Column:
    """Type of a match: the first in order whose pattern it fits whole."""
    return reduce(lambda rest, k: F.when(m.rlike(f"^(?:{KINDS[k]})$"), F.lit(k)).otherwise(rest), reversed(list(KINDS)), F.lit("name"))


@cache
def wide() -> tuple[list[str], list[tuple[int, int]]]:
    """Alphabets of all letters beyond ASCII, by the rule: letters of one script and category, vowels and others apart
    where accents tell, common ones apart from rare ones; and runs of 256 or more letters as (first, count)."""
    runs: list[list] = []
    for cp in range(0x80, 0x110000):
        cat = unicodedata.category(chr(cp))
        if cat[0] == "L":
            if runs and runs[-1][0] == cat and runs[-1][1] + runs[-1][2] == cp:
                runs[-1][2] += 1
            else:
                runs.append([cat, cp, 1])
    groups: dict[tuple, list[str]] = {}
    for cat, first, n in runs:
        if n >= 256:
            continue
        for c in map(chr, range(first, first + n)):
            script = unicodedata.name(c, "?").split()[0]
            base = unicodedata.normalize("NFD", c)[0].lower()
            vowel = base in "aeiouyæøœαεηιουωаеиоуыэюяєі" if script in ("LATIN", "GREEK", "CYRILLIC") else None
            common = ord(c) < 0x180 or 0x386 <= ord(c) < 0x3CF or 0x410 <= ord(c) < 0x450
            groups.setdefault((script, cat, vowel, common, unicodedata.normalize("NFKC", c) == c), []).append(c)
    for key in [k for k, v in groups.items() if len(v) == 1]:
        groups.setdefault(("", key[1]), []).extend(groups.pop(key))
    return ["".join(g) for g in groups.values()], [(first, n) for _, first, n in runs if n >= 256]


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


#: Code points from here on stand for numbers in tables that translate() looks up.
_NUMBERS = 0x4E00


def _beyond(c: Column, by: Column) -> Column:
    """A letter beyond ASCII moved on by `by` places in its alphabet or run; other characters stay."""
    alphabets, runs = wide()
    every = "".join(alphabets)
    first = [sum(map(len, alphabets[:k])) for k, a in enumerate(alphabets) for _ in a]
    size = [len(a) for a in alphabets for _ in a]
    all_runs = F.from_json(F.lit(str([list(r) for r in runs])), "array<array<int>>")

    def looked_up(c: Column, values: list[int]) -> Column:
        return F.ascii(F.translate(c, every, "".join(chr(_NUMBERS + v) for v in values))) - _NUMBERS

    def moved(x: Column) -> Column:
        at = F.when(F.instr(F.lit(every), x["c"]) > 0, F.array(looked_up(x["c"], first), looked_up(x["c"], size), looked_up(x["c"], list(range(len(every))))))
        run = F.get(F.filter(all_runs, lambda r: x["cp"].between(r[0], r[0] + r[1] - 1)), 0)
        return F.struct(x["c"].alias("c"), x["by"].alias("by"), x["cp"].alias("cp"), at.alias("at"), F.when(at.isNull(), run).alias("run"))

    def new(y: Column) -> Column:
        listed = F.lit(every).substr(y["at"][0] + (y["at"][2] - y["at"][0] + y["by"]) % y["at"][1] + 1, F.lit(1))
        far = F.decode(F.unhex(F.lpad(F.hex(y["run"][0] + (y["cp"] - y["run"][0] + y["by"]) % y["run"][1]), 8, "0")), "UTF-32")
        return F.when(y["at"].isNotNull(), listed).when(y["run"].isNotNull(), far).otherwise(y["c"])

    return _once(_once(F.struct(c.alias("c"), by.alias("by"), F.ascii(c).alias("cp")), moved), new)


def _permute(body: Column, key: Column, use: Column) -> Column:
    """A keyed permutation of the strings with body's pattern of alphabets: a Feistel network over odd and even places.

    `use` names the set of alphabets; letters beyond ASCII move in an alphabet of their script and category.
    """
    sets = []
    for name, alphabets in SETS.items():
        place = {c: (sum(map(len, alphabets[:k])) + 1, len(a)) for k, a in enumerate(alphabets) for c in a}
        sets.append({"name": name, "every": "".join(alphabets), "first": [place[c][0] for a in alphabets for c in a], "size": [place[c][1] for a in alphabets for c in a]})
    every = F.from_json(F.lit(json.dumps(sets)), "array<struct<name:string,every:string,first:array<int>,size:array<int>>>")

    def permuted(z: Column) -> Column:
        own = z["own"]

        def turn(acc: Column, r: Column) -> Column:
            def shifted(x: Column) -> Column:
                def moved(c: Column, i: Column) -> Column:
                    by = F.conv(x["stream"].substr((i * 3) % 250 + 1, F.lit(3)), 16, 10).cast("int")

                    def found(y: Column) -> Column:
                        first = F.get(own["first"], y["at"] - 1)
                        new = own["every"].substr(first + (y["at"] - first + y["by"]) % F.get(own["size"], y["at"] - 1), F.lit(1))
                        return F.when(y["at"] > 0, new).when(c > "\x7f", _beyond(c, y["by"])).otherwise(c)

                    return F.when((i + r) % 2 == 1, c).otherwise(_once(F.struct(F.instr(own["every"], c).alias("at"), by.alias("by")), found))

                return F.array_join(F.transform(x["chars"], moved), "")

            def streamed(x: Column) -> Column:
                return F.struct(x["chars"].alias("chars"), F.concat(x["digest"], F.sha2(x["digest"], 512)).alias("stream"))

            chars = _chars(acc)
            other = F.array_join(F.filter(chars, lambda c, i: (i + r) % 2 == 1), "")
            digest = F.sha2(F.concat_ws("\x1f", z["key"], r.cast("string"), F.length(acc).cast("string"), other), 512)
            return _once(_once(F.struct(chars.alias("chars"), digest.alias("digest")), streamed), shifted)

        return F.aggregate(F.array(*[F.lit(r) for r in range(6)]), z["body"], turn)

    own = F.get(F.filter(every, lambda x: x["name"] == use), 0)
    return _once(F.struct(body.alias("body"), key.alias("key"), own.alias("own")), permuted)


def _octets(core: Column, key: Column) -> Column:
    """A keyed permutation of IPv4 addresses, by octet pairs; 10-like private first octets aren't kept apart."""

    def turn(acc: Column, r: Column) -> Column:
        part = F.split(acc, r"\.")
        other = F.array_join(F.filter(part, lambda c, i: (i + r) % 2 == 1), ".")
        digest = F.sha2(F.concat_ws("\x1f", key, r.cast("string"), other), 256)
        return F.array_join(F.transform(part, lambda c, i: F.when((i + r) % 2 == 1, c).otherwise(((c.cast("int") + F.conv(digest.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int")) % 256).cast("string"))), ".")

    return F.aggregate(F.array(*[F.lit(r) for r in range(6)]), core, turn)


def _luhn(digits: Column) -> Column:
    """Check digit for digits, which come without one."""
    back = _chars(F.reverse(digits))
    parts = F.transform(back, lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.pmod(-F.aggregate(parts, F.lit(0), lambda a, x: a + x), F.lit(10))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


#: Draws of a stand-in from a list, before letters are permuted; and the mark of an entity that no draw suits.
POOL_TRIES, TOKEN = 4, -1


_PREFIX = r"^((?i:token|password|passwd|pwd|secret|api[_-]?key)[ \t]*[=:][ \t]*[\"']?)"


def core(k: Column, m: Column) -> Column:
    """What identifies an entity: two mentions with equal type and core are the same one."""
    return (
        F.when(k == "secret", F.regexp_replace(m, _PREFIX, ""))
        .when(k == "email", F.lower(m))
        .when(k.isin("card", "ssn"), _digits(m))
        .when(k == "phone", F.when(m.startswith("+"), F.concat(F.lit("+"), _digits(m))).otherwise(_digits(m)))
        .when(k == "name", F.regexp_replace(m, rf"^{_lead}", ""))
        .when(k == "iban", F.regexp_replace(m, " ", ""))
        .otherwise(m)
    )


def _stand_in(w: Column, key: Column) -> Column:
    """For a given name of the lists, one that stands in for it, by the names' orders under the key; null for others."""
    lists = F.from_json(F.lit(json.dumps([{"own": v, "pool": STAND_IN[k]} for k, v in GIVEN.items()])), "array<struct<own:array<string>,pool:array<string>>>")

    def order(n: Column) -> Column:
        return F.sha2(F.concat(key, F.lit("\x1f"), n), 256)

    def drawn(x: Column) -> Column:
        pool = F.array_sort(F.transform(x["pool"], lambda n: F.struct(order(n).alias("o"), n.alias("n"))))
        return F.get(pool, F.size(F.filter(x["own"], lambda n: order(n) < order(w))))["n"]

    return F.get(F.transform(F.filter(lists, lambda x: F.array_contains(x["own"], w)), drawn), 0)


def _parts(k: Column, c: Column) -> Column:
    """A core as a list of (fixed, body, salt, use): what stays, then what is permuted under the key and the salt."""

    def part(fixed: Column | str, body: Column | str, salt: Column | str = "", use: str = "plain") -> Column:
        return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in zip(("fixed", "body", "salt", "use"), (fixed, body, salt, use), strict=True)])

    size = F.length(c)
    at = F.instr(c, "@")
    domain = c.substr(at + 1, size)
    head = F.when(c.startswith("+"), F.greatest(F.lit(1), size - 10)).otherwise(F.lit(0))
    end = F.when(c.rlike(r"^..+" + ENDINGS), F.regexp_extract(c, ENDINGS, 0)).otherwise("")
    secret = k.isin("key", "secret")
    return (
        F.when(k == "email", F.array(part("", c.substr(F.lit(1), at - 1), c.substr(at, size)), part("@", F.substring_index(domain, ".", 1)), part(F.regexp_replace(domain, r"^[^.]*", ""), "")))
        .when(k == "name", F.array(part("", c.substr(F.lit(1), size - F.length(end)), end), part(end, "")))
        .when(k == "card", F.array(part(c.substr(1, 1), c.substr(F.lit(2), size - 2))))
        .when(k == "phone", F.array(part(c.substr(F.lit(1), head), c.substr(head + 1, size), c.substr(F.lit(1), head))))
        .when(k == "iban", F.array(part(c.substr(1, 2), c.substr(F.lit(3), size), "", "iban")))
        .when(secret & c.rlike("^[0-9a-f]+$"), F.array(part("", c, "", "hex")))
        .when((k == "key") & c.rlike("^[0-9A-F]+$"), F.array(part("", c, "", "HEX")))
        .when((k == "key") & c.startswith("AKIA"), F.array(part("AKIA", c.substr(F.lit(5), size), "", "upper")))
        .otherwise(F.array(part("", c)))
    )


def surrogate(k: Column, c: Column, key: Column, tries: Column) -> Column:
    """Of a core, a core of the same type and format; of type name, c is one word.

    For equal tries it is a permutation within a type and pattern, so distinct cores stay distinct; stand-ins for
    given names are distinct as well. With tries TOKEN it is a keyed token of 24 hexadecimal digits, the way out where
    no draw suits.
    """

    def made(x: Column) -> Column:
        k, c, own = x["k"], x["c"], x["own"]
        joined = F.array_join(F.transform(_parts(k, c), lambda p: F.concat(p["fixed"], F.when(p["body"] == "", "").otherwise(_permute(p["body"], F.concat(own, p["salt"]), p["use"])))), "")

        def closed(j: Column) -> Column:
            # the last digit of a card keeps its distance to the check digit
            check = F.pmod(_luhn(j) + c.substr(-1, 1).cast("int") - _luhn(c.substr(F.lit(1), F.length(c) - 1)), F.lit(10))
            return F.when(k == "card", F.concat(j, check.cast("string"))).otherwise(j)

        token = F.concat(F.lit("X"), F.sha2(F.concat_ws("\x1f", key, k, c), 256).substr(1, 24))
        listed = F.when((k == "name") & (x["tries"] < POOL_TRIES), _stand_in(c, own))
        return F.when(x["tries"] == TOKEN, token).when(k == "ip", _octets(c, own)).otherwise(F.coalesce(listed, _once(joined, closed)))

    own = F.when(tries > 0, F.concat(key, tries.cast("string"))).otherwise(key)
    return _once(F.struct(k.alias("k"), c.alias("c"), tries.alias("tries"), own.alias("own")), made)


def dressed(k: Column, m: Column, sub: Column, token: Column) -> Column:
    """The surrogate core in the mention's own format: separators, case, title and keyword; a token as it is."""

    def fill(c: Column, i: Column) -> Column:
        before = F.length(_digits(m.substr(F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), _digits(sub).substr(before + 1, F.lit(1))).otherwise(c)

    cased = F.array_join(F.transform(_chars(sub), lambda c, i: F.when(m.substr(i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    spaced = F.array_join(F.transform(_chars(m), lambda c, i: F.when(c == " ", c).otherwise(sub.substr(F.length(F.regexp_replace(m.substr(F.lit(1), i), " ", "")) + 1, F.lit(1)))), "")
    return (
        F.when(k == "secret", F.concat(F.regexp_extract(m, _PREFIX, 1), sub))
        .when(k == "name", F.concat(F.regexp_extract(m, rf"^(?:{_lead})?", 0), sub))
        .when(token, sub)
        .when(k == "email", cased)
        .when(k.isin("card", "ssn", "phone"), F.array_join(F.transform(_chars(m), fill), ""))
        .when(k == "iban", spaced)
        .otherwise(sub)
    )


def mentions(text: Column) -> Column:
    """Matches in order, each with its type and core."""
    return F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: F.struct(m.alias("m"), kind(m).alias("k"))).alias("found")


def _with_core(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["m"].alias("m"), x["k"].alias("k"), core(x["k"], x["m"]).alias("c")))


def detected(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _weft_found, an array of (m, k, c); empty for null texts and texts without an entity."""
    # every alternative holds a digit, an @, a keyword with = or :, a key's start or letters, or two words of which the second has a capital
    likely = F.col(text).rlike(r"[0-9@=:]|AKIA|ghp_|sk-|[a-f]{32}|[A-F]{32}|\p{Lu}[\p{L}\p{M}'’-]*+\.? [\p{Lu}\p{Lo}]|(?:[nN]ame ist?|ch hei(?:ß|ss)e|appelle|llamo|nombre es|зовут|λένε) ")
    got = docs.withColumn("_weft_found", F.when(likely, mentions(F.col(text))))
    return got.withColumn("_weft_found", F.coalesce(_with_core(F.col("_weft_found")), F.array().cast("array<struct<m:string,k:string,c:string>>")))


def _entities(found: Column) -> Column:
    """(k, c) of what is replaced: cores, those of names word by word, so that a surname keeps its surrogate anywhere."""
    return F.flatten(F.transform(found, lambda x: F.transform(F.when(x["k"] == "name", F.split(x["c"], " ")).otherwise(F.array(x["c"])), lambda c: F.struct(x["k"].alias("k"), c.alias("c")))))


#: Entities of a task that computes surrogates, which is much work for few bytes.
PER_TASK = 2_000


def retries(docs: DataFrame, key: str, text: str = "text", rounds: int = 8) -> DataFrame:
    """Collision check over the whole corpus: rows (k, c, tries), tries not 0, of entities that need another draw.

    A surrogate that is itself an entity of the corpus, or that another entity has already taken, is drawn again under
    the next key. Entities left after all rounds, as their type has no free value or their core nothing that can
    change, take a token (tries TOKEN). So surrogates are distinct, and none is an entity of the corpus.
    """
    real = cut(detected(docs, text).select(F.explode(_entities(F.col("_weft_found"))).alias("x")).select("x.k", "x.c").groupBy("k", "c").agg(F.lit(1).alias("one")).select("k", "c"))

    def drawn(df: DataFrame) -> DataFrame:
        return df.select("k", "c", "tries", surrogate(F.col("k"), F.col("c"), F.lit(key), F.col("tries")).alias("s"))

    state = cut(drawn(real.withColumn("tries", F.lit(0)).repartition(max(1, -(-real.count() // PER_TASK)), "k", "c")))
    for n in range(1, rounds + 2):
        # the entity with the fewest tries keeps a shared surrogate, then the least core
        keep = state.groupBy("k", "s").agg(F.min(F.struct("tries", "c"))["c"].alias("keeper"))
        taken = real.select("k", F.col("c").alias("s"), F.lit(True).alias("is_real"))
        judged = state.join(keep, ["k", "s"]).join(taken, ["k", "s"], "left")
        state = cut(judged.withColumn("bad", (F.col("tries") != TOKEN) & (F.col("is_real").isNotNull() | (F.col("keeper") != F.col("c")))).select("k", "c", "tries", "s", "bad"))
        bad = state.where("bad").count()
        if not bad:
            break
        again = state.where("bad").select("k", "c", F.lit(n if n <= rounds else TOKEN).alias("tries")).repartition(-(-bad // PER_TASK), "k", "c")
        state = cut(drawn(again).unionByName(state.where("not bad").select("k", "c", "tries", "s")))
    return state.where("tries <> 0").select("k", "c", "tries")


def replace(docs: DataFrame, key: str, text: str = "text", again: DataFrame | None = None) -> DataFrame:
    """docs with entities of `text` replaced, and n_entities, the number of replaced mentions (a column of that name is
    replaced).

    Equal entities get equal surrogates everywhere, whatever their format; distinct ones get distinct ones, and no
    surrogate is an entity of the corpus. Names are entities word by word. A null text stays null with 0 entities,
    texts without an entity stay as they are, repeated rows are treated alike, an empty table gives no rows, other
    columns are untouched.
    """
    again = retries(docs, key, text) if again is None else again
    got = detected(docs, text)
    if again.limit(1).count():
        # by text, so that no list outgrows a text, however many rows share an id; equal hashes only share a list
        here = got.where(F.size("_weft_found") > 0).select(F.xxhash64(text).alias("_weft_id"), F.explode(F.array_distinct(_entities(F.col("_weft_found")))).alias("x")).select("_weft_id", "x.k", "x.c").distinct()
        by_text = here.join(again, ["k", "c"]).groupBy("_weft_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "k", "c"), "tries"))).alias("_weft_again"))
        got = got.join(cut(by_text), F.xxhash64(text) == F.col("_weft_id"), "left").drop("_weft_id")
    else:
        got = got.withColumn("_weft_again", F.lit(None).cast("map<string,int>"))

    def tries(k: Column, c: Column) -> Column:
        return F.coalesce(F.element_at(F.col("_weft_again"), F.concat_ws("\x1f", k, c)), F.lit(0))

    def drawn(x: Column) -> Column:
        cores = F.when(x["k"] == "name", F.split(x["c"], " ")).otherwise(F.array(x["c"]))
        subs = F.transform(cores, lambda c: surrogate(x["k"], c, F.lit(key), tries(x["k"], c)))
        return F.struct(x["k"].alias("k"), x["m"].alias("m"), F.array_join(subs, " ").alias("s"), (tries(x["k"], x["c"]) == TOKEN).alias("token"))

    subs = F.transform(F.transform("_weft_found", drawn), lambda x: dressed(x["k"], x["m"], x["s"], x["token"]))
    got = got.withColumn("_weft_sub", F.when(F.size("_weft_found") > 0, subs))
    parts = F.split(F.col(text), PATTERN, -1)
    joined = F.array_join(F.zip_with(parts, F.concat(F.col("_weft_sub"), F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    return got.withColumn("n_entities", F.size("_weft_found")).withColumn(text, F.when(F.col("_weft_sub").isNotNull(), joined).otherwise(F.col(text))).drop("_weft_found", "_weft_sub", "_weft_again")
