"""Problem 2: variant spellings of names of people and bodies.

Names are brought to comparable parts (surname, given names, generation; place
and body), and words that differ by typing errors are linked by a pigeonhole
segment join: a string within k edits of another shares at least one of its k+1
segments with it, shifted by k at most.  So each key is cut into k+1 segments
that form an inverted index, every other key looks up its shifted substrings,
and what meets is verified by a banded edit distance.

One join serves all parts: surnames, given names, places, and the words of
bodies are one vocabulary, grouped by role and first letter.  Nearness alone
links nothing; a link needs support from how its two words occur:

* a surname goes to one that occurs with the same initials, and not if it is
  itself found with several (one that stands alone, without a given name, is
  taken as it is spelt);
* a given name, or a word of a body, goes to one that is far more frequent, so
  two names of their own (Eric, Erica) stay apart, as do two fields (Law, Art);
* a body as a whole goes to one of its place that it differs from by glued or
  split words, or by a slip in a short word.

A misspelt word goes to the nearest of the words that support it.  Initials,
nicknames, left-out middle names and inverted order are settled on the parts, by
joins on keys; nowhere are all names of a surname compared with each other.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.session import cut, shuffle_width

PLACEHOLDERS = ["", "Anonymous", "Unknown"]

#: Words of names; fixed values.
TITLES = set("dr prof professor mr mrs ms miss sir lord lady rev reverend hon".split())
PARTICLES = set("de den der del della di da du dos la le van von ten ter te zu zum af av".split())
GENERATIONS = {"jr": "jr", "junior": "jr", "sr": "sr", "senior": "sr", "ii": "ii", "iii": "iii", "iv": "iv"}
LINKS = set("of for and the in at to".split())
BODIES = {
    "university": "univ", "institute": "inst", "institution": "instn", "society": "soc", "department": "dept", "association": "assoc", "laboratory": "lab",
    "company": "co", "committee": "cttee", "college": "coll", "academy": "acad", "museum": "mus", "library": "lib", "bureau": "bur", "council": "cncl", "commission": "comm",
    "ministry": "min", "foundation": "fdn", "school": "sch", "centre": "ctr", "office": "off", "board": "bd", "faculty": "fac",
}
BODY_SHORT = {short: full for full, short in BODIES.items()} | {"center": "centre", "dep": "department", "corp": "company"}
#: Nicknames and the given names they may stand for; fixed values.
NICKNAMES = {
    "toby": "tobias", "ted": "edward theodore edmund", "teddy": "theodore edward", "ned": "edward edmund", "eddie": "edward edmund", "rita": "margaret marguerite", "peggy": "margaret", "maggie": "margaret marguerite",
    "meg": "margaret", "daisy": "margaret marguerite", "margot": "marguerite margaret", "bea": "beatrice", "trixie": "beatrice", "bella": "isabella", "izzy": "isabella", "ella": "isabella", "gus": "augustine augustus", "austin": "augustine",
    "lizzie": "elizabeth", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "nat": "nathaniel", "nate": "nathaniel", "leo": "leopold", "fred": "frederick", "freddie": "frederick", "fritz": "frederick",
    "dolly": "dorothea dorothy", "dora": "dorothea", "dot": "dorothea dorothy", "thea": "dorothea theodora", "theo": "theodore", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "neil": "cornelius", "con": "cornelius", "hetty": "henrietta harriet", "etta": "henrietta",
    "hattie": "harriet henrietta", "harry": "harriet henry", "pippa": "philippa", "abby": "abigail", "gail": "abigail", "kitty": "katherine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kay": "katherine", "will": "william", "bill": "william",
    "billy": "william", "willy": "william", "uli": "ulrich", "ulli": "ulrich", "zack": "zachary", "zach": "zachary", "alec": "alexander", "alex": "alexander", "sandy": "alexander", "sasha": "alexander", "sue": "susannah", "susie": "susannah", "susan": "susannah",
    "oz": "oswald", "ozzie": "oswald", "trudy": "gertrude", "gertie": "gertrude", "dick": "richard", "rick": "richard", "richie": "richard", "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert albert", "larry": "lawrence", "laurie": "lawrence",
    "ben": "benjamin", "benny": "benjamin", "charlie": "charles", "chuck": "charles", "josie": "josephine", "jo": "josephine", "walt": "walter", "wally": "walter", "yoli": "yolanda", "quin": "quentin", "jim": "james", "jimmy": "james", "jack": "john", "johnny": "john",
    "tom": "thomas", "tommy": "thomas", "mike": "michael", "dave": "david", "steve": "stephen", "tony": "anthony", "joe": "joseph", "sam": "samuel", "dan": "daniel", "pat": "patrick patricia", "nell": "eleanor helen", "nora": "eleanor", "polly": "mary", "molly": "mary", "sally": "sarah", "fanny": "frances", "frank": "francis", "hal": "henry", "hank": "henry", "andy": "andrew", "greg": "gregory", "phil": "philip", "ron": "ronald", "jerry": "gerald", "jeff": "geoffrey", "nick": "nicholas", "tim": "timothy", "matt": "matthew", "chris": "christopher", "tilly": "matilda", "minnie": "wilhelmina", "millie": "mildred", "winnie": "winifred", "letty": "lettice", "lottie": "charlotte", "nan": "anne", "nancy": "anne",
}
#: Digits read for letters, and letters without a decomposition; fixed values.
READ_AS = str.maketrans({"0": "o", "1": "l", "5": "s", "3": "e", "4": "a"})
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i"})

_TOKEN = re.compile(r"[^\W_]+")
#: A particle written together with the surname.
_GLUED = re.compile(r"\b([Vv]an|[Vv]on|[Dd]e|[Dd]er|[Dd]el)(?=[A-Z][a-zà-ÿ])")


def plain(text: str) -> str:
    """Small letters without accents."""
    spread = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in spread if not unicodedata.combining(c)).translate(PLAIN)


def _words(text: str) -> list[str]:
    """Words of a plain text; digits inside words read as letters, numbers dropped."""
    out = []
    for w in _TOKEN.findall(text):
        if w.isdigit():
            continue
        out.append(w.translate(READ_AS) if any(c.isdigit() for c in w) else w)
    return out


def _near(a: str, b: str, most: int) -> bool:
    """Edit distance of at most ``most``, within a band of that width."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        if min(new) > most:
            return False
        row = new
    return row[-1] <= most


@lru_cache(maxsize=1 << 16)
def is_link(word: str) -> bool:
    """Whether a word of a body's name is a link word, or one with a letter left out, doubled, or swapped with its neighbour."""
    if word in LINKS:
        return True
    if len(word) > 4:
        return False
    for w in LINKS:
        slips = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[: i + 1] + w[i:] for i in range(len(w))} | {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for i in range(len(w) - 1)}
        if word in slips:
            return True
    return False


@lru_cache(maxsize=1 << 16)
def body_word(word: str) -> str | None:
    """The kind of body a word means, short forms and typing errors included."""
    if word in BODIES:
        return word
    if word in BODY_SHORT:
        return BODY_SHORT[word]
    if len(word) >= 6:
        return next((b for b in BODIES if len(b) >= 6 and _near(word, b, 2)), None)
    return None


def _meant(nicknames: dict[str, str]) -> Column:
    """Nickname -> the names it may stand for."""
    return F.create_map(*[x for nick, full in nicknames.items() for x in (F.lit(nick), F.split(F.lit(full), " "))]) if nicknames else F.create_map().cast("map<string,array<string>>")


def parse_name(name: str) -> dict:
    """Parts of one name.

    A body has ``kind`` 'body', ``key`` (its place) and ``rest`` (the words of what
    it is and does).  A person has ``key`` (surname), ``given``, ``middle`` (an initial)
    and ``generation``; where nothing shows which end the surname is at, ``key``
    is null and ``first`` and ``last`` are its two ends.
    """
    out = dict.fromkeys(["key", "rest", "given", "middle", "generation", "first", "last", "given_if_first", "middle_if_first", "given_if_last", "middle_if_last"])
    text = plain(_GLUED.sub(r"\1 ", name)).replace("&", " and ")
    words = _words(text)
    kinds = [body_word(w) for w in words]
    if len(words) >= 3 and any(kinds) and any(map(is_link, words)) or "(" in text and any(kinds):
        out["kind"] = "body"
        if words[0] == "the":
            text = re.sub(r"^\W*the\b", "", text)
            words = words[1:]
        head, _, tail = text.partition(",")
        if tail.strip() and _words(head) and body_word(_words(head)[0]):
            place, rest = "".join(_words(tail)), _words(head)
        else:
            place, rest = words[0], words[1:]
        out["key"], out["rest"] = place, " ".join(body_word(w) or w for w in rest if not is_link(w))
        return out
    out["kind"] = "person"
    generation = ""
    inner = re.search(r"\(([^)]*)\)", text)
    text = re.sub(r"\([^)]*\)", " ", text)
    parts = [p for p in text.split(",")]

    def strip(words: list[str]) -> list[str]:
        nonlocal generation
        kept = []
        for i, w in enumerate(words):
            if w in GENERATIONS and (len(words) > 1 or len(parts) > 1):
                generation = generation or GENERATIONS[w]
            elif w not in TITLES:
                kept.append(w)
        return kept

    lists = [strip(_words(p)) for p in parts]
    out["generation"] = generation = generation or ""

    def surname(words: list[str]) -> str | None:
        own = [w for w in words if w not in PARTICLES] or words
        return max(own, key=lambda w: (len(w) > 4, own.index(w))) if own else None

    def given(words: list[str]) -> tuple[str | None, str | None]:
        words = [w for w in words if w not in PARTICLES] or words
        if inner and (spelt := _words(inner.group(1))):
            return spelt[0], (spelt[1][0] if len(spelt) > 1 else None)
        return (words[0] if words else None), (words[1][0] if len(words) > 1 else None)

    if len(lists) > 1 and lists[0] and any(lists[1:]):
        out["key"] = surname(lists[0])
        out["given"], out["middle"] = given([w for part in lists[1:] for w in part])
        return out
    whole = [w for part in lists for w in part]
    own = [w for w in whole if w not in PARTICLES]
    if len(own) <= 1:
        out["key"] = own[0] if own else None
        out["given"], out["middle"] = given([])
        return out
    first, last = own[0], own[-1]
    particle = next((i for i, w in enumerate(whole) if w in PARTICLES), None)
    at_front = (given(own[1:]), first)
    at_end = (given(own[:-1]), last)
    if len(last) == 1 and len(first) > 1 or particle == 0:
        (out["given"], out["middle"]), out["key"] = at_front
    elif len(first) == 1 and len(last) > 1 or particle is not None:
        (out["given"], out["middle"]), out["key"] = at_end
    else:
        out["first"], out["last"] = first, last
        out["given_if_first"], out["middle_if_first"] = at_front[0]
        out["given_if_last"], out["middle_if_last"] = at_end[0]
    return out


_PARTS = ["kind", "key", "rest", "given", "middle", "generation", "first", "last", "given_if_first", "middle_if_first", "given_if_last", "middle_if_last"]


def parsed_names(names: DataFrame) -> DataFrame:
    """``name`` and the parts of every row of ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_name(x) for x in batch.column("name").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("name"), *(pa.array([r[p] for r in rows], pa.string()) for p in _PARTS)], names=["name", *_PARTS])

    return names.select("name").mapInArrow(run, "name string, " + ", ".join(f"{p} string" for p in _PARTS))


def settle_order(parsed: DataFrame, nicknames: dict[str, str] = NICKNAMES) -> DataFrame:
    """Surname and given name of those whose order isn't shown, by how their ends occur elsewhere: ``name``, ``kind``, ``key``, ``rest``, ``given``, ``middle``, ``generation``."""
    shown = parsed.filter("kind = 'person' and key is not null and given is not null")
    roles = shown.select(F.inline(F.array(F.struct(F.col("key").alias("word"), F.lit(1).alias("role")), F.struct(F.col("given").alias("word"), F.lit(-1).alias("role")))))
    roles = roles.groupBy("word").agg(F.signum(F.sum("role")).alias("role"))
    unclear = parsed.filter("kind = 'person' and first is not null")
    ends = unclear.select("name", F.inline(F.array(F.struct(F.lit(1).alias("side"), F.col("first").alias("word")), F.struct(F.lit(-1).alias("side"), F.col("last").alias("word")))))
    role = F.when(F.col("word").isin(list(nicknames)), -1.0).otherwise(F.coalesce("role", F.lit(0.0)))
    sides = ends.join(roles, "word", "left").groupBy("name").agg(F.sum(F.col("side") * role).alias("front"))
    front = F.col("front") > 0
    pick = lambda a, b: F.when(front, F.col(a)).otherwise(F.col(b))
    settled = unclear.join(sides, "name").select("name", "kind", pick("first", "last").alias("key"), "rest", pick("given_if_first", "given_if_last").alias("given"), pick("middle_if_first", "middle_if_last").alias("middle"), "generation")
    rest = parsed.filter("first is null").select("name", "kind", "key", "rest", "given", "middle", "generation")
    return rest.unionByName(settled).filter("key is not null")


# -- pigeonhole segment join ---------------------------------------------------


def _segments(length: Column, edits: Column) -> Column:
    """Start (from 1) and size of the edits+1 even segments of a string of a length."""
    base, extra = F.floor(length / (edits + 1)).cast("int"), length % (edits + 1)
    short = edits + 1 - extra  # the last `extra` segments have one more
    return F.transform(F.sequence(F.lit(0), edits), lambda i: F.struct(i.alias("i"), (i * base + F.greatest(i - short, F.lit(0)) + 1).alias("at"), (base + F.when(i >= short, 1).otherwise(0)).alias("size")))


def _met_keys(keys: DataFrame, classes: list[tuple[int, int]]) -> DataFrame:
    """Pairs of different keys of one ``grp`` within the edits of the shorter one: ``grp``, ``a``, ``b`` (b no longer than a), ``ia``, ``ib``, ``distance``; a pair comes once for every segment it shares.

    ``keys`` has distinct (grp, key) and ``info``, which comes out on both sides.
    ``classes`` has (least length, edits), lengths rising; shorter keys meet nothing.
    Both sides are shuffled: Spark's estimates don't see that a key becomes many
    segments, so a side far above the limit of a broadcast would be sent through the driver.
    """
    most = max(k for _, k in classes)
    least = min(n for n, _ in classes)

    def edits(n: Column) -> Column:
        e = F.lit(-1)
        for at, k in classes:
            e = F.when(n >= at, k).otherwise(e)
        return e

    keys = keys.select("grp", "key", "info", F.length("key").alias("len")).filter(F.col("len") >= least)
    k = edits(F.col("len"))
    index = keys.select("grp", F.col("key").alias("b"), F.col("info").alias("ib"), F.col("len").alias("size_b"), F.explode(_segments(F.col("len"), k)).alias("s"))
    index = index.select("grp", "b", "ib", "size_b", F.col("s.i").alias("i"), F.substring("b", F.col("s.at"), F.col("s.size")).alias("seg"))
    n = F.col("len")
    sizes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda d: n - d), lambda m: n - m <= edits(m))
    looked = keys.select("grp", F.col("key").alias("a"), F.col("info").alias("ia"), "len", F.explode(sizes).alias("size_b"))
    looked = looked.select("*", F.explode(_segments(F.col("size_b"), edits(F.col("size_b")))).alias("s"))
    gap, k = F.col("len") - F.col("size_b"), edits(F.col("size_b"))
    low = F.greatest(F.lit(1), F.col("s.at") - F.floor((k - gap) / 2).cast("int"))
    high = F.least(F.col("len") - F.col("s.size") + 1, F.col("s.at") + F.floor((k + gap) / 2).cast("int"))
    looked = looked.withColumns({"low": low, "high": high}).filter("low <= high")
    shifted = F.array_distinct(F.transform(F.sequence(F.col("low"), F.col("high")), lambda p: F.substring(F.col("a"), p, F.col("s.size"))))
    looked = looked.select("grp", "a", "ia", "size_b", F.col("s.i").alias("i"), F.explode(shifted).alias("seg"))
    met = looked.join(index.hint("merge"), ["grp", "size_b", "i", "seg"]).filter((F.length("a") > F.length("b")) | (F.col("a") > F.col("b")))
    near = F.levenshtein("a", "b", most)
    return met.select("grp", "a", "b", "ia", "ib", near.alias("distance")).filter((F.col("distance") >= 0) & (F.col("distance") <= edits(F.length("b"))))


def segment_join(keys: DataFrame, edits: int) -> DataFrame:
    """Pairs of different ``key`` of one ``grp`` within ``edits`` edits: ``grp``, ``a``, ``b`` (b no longer than a), ``distance``.

    ``keys`` has distinct (grp, key).  Keys of ``edits`` characters or fewer meet
    nothing here, but in ``close_keys``.  The pigeonhole principle makes the join
    complete for the others; the banded edit distance makes it exact.
    """
    met = _met_keys(keys.select("grp", "key", F.lit(0).alias("info")), [(edits + 1, edits)])
    return met.select("grp", "a", "b", "distance").distinct()


def _short_meetings(keys: DataFrame, edits: int) -> DataFrame:
    """``grp``, ``a``, ``b``: pairs of which ``b`` has ``edits`` characters or fewer and that share what up to ``edits`` deletions leave of each."""
    left = keys.select("grp", "key", F.col("key").alias("left")).filter(F.length("key") <= 2 * edits)
    step = left
    for _ in range(edits):
        drop = F.transform(F.sequence(F.lit(1), F.length("left")), lambda i: F.concat(F.substring("left", F.lit(1), i - 1), F.substring("left", i + 1, F.length("left"))))
        step = step.filter("left <> ''").select("grp", "key", F.explode(drop).alias("left")).distinct()
        left = left.unionByName(step)
    left = left.distinct()
    short = left.filter(F.length("key") <= edits).withColumnRenamed("key", "b")
    met = left.withColumnRenamed("key", "a").join(short.hint("merge"), ["grp", "left"])  # as in _met_keys
    return met.filter((F.length("a") > F.length("b")) | (F.length("a") == F.length("b")) & (F.col("a") > F.col("b"))).select("grp", "a", "b").distinct()


def close_keys(keys: DataFrame, edits: int) -> DataFrame:
    """All pairs of different ``key`` of one ``grp`` within ``edits`` edits, short keys too; columns as of ``segment_join``."""
    short = _short_meetings(keys, edits).withColumn("distance", F.levenshtein("a", "b", edits)).filter("distance >= 0")
    return segment_join(keys, edits).unionByName(short)


def settle_spellings(keys: DataFrame, edits: int, allowed: Column) -> DataFrame:
    """``grp``, ``key``, ``root``: every key with the spelling it leads to in the end.

    ``keys`` has (grp, key, n).  A key leads to the nearest of the more frequent
    keys it is linked to, of equally near ones to the most frequent; to one just
    as frequent (the greater) only if none is more frequent; ``allowed`` (over a, b, distance) may narrow the links.
    """
    keys = cut(keys.groupBy("grp", "key").agg(F.sum("n").alias("n")))
    pairs = close_keys(keys, edits).filter(allowed)
    rank = keys.select("grp", F.col("key").alias("k"), F.struct("n", "key").alias("rank"))
    ranked = pairs.join(rank.withColumnsRenamed({"k": "a", "rank": "ra"}), ["grp", "a"]).join(rank.withColumnsRenamed({"k": "b", "rank": "rb"}), ["grp", "b"])
    up = ranked.select("grp", F.when(F.col("ra") < F.col("rb"), F.col("a")).otherwise(F.col("b")).alias("key"), F.greatest("ra", "rb").alias("to"), (F.col("ra.n") != F.col("rb.n")).alias("more"), "distance")
    best = F.max_by("to", F.struct("more", (-F.col("distance")).alias("near"), "to"))
    up = cut(up.groupBy("grp", "key").agg(best.alias("to")).select("grp", "key", F.col("to.key").alias("root")))
    for _ in range(30):  # every step doubles the way; links only lead up, so it ends
        on = up.select("grp", F.col("key").alias("root"), F.col("root").alias("further"))
        stepped = up.join(on, ["grp", "root"], "left")
        moved = cut(stepped.select("grp", "key", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        up = moved.drop("moved")
        if not moved.filter("moved").limit(1).count():
            break
    return keys.select("grp", "key").join(up, ["grp", "key"], "left").select("grp", "key", F.coalesce("root", "key").alias("root"))


# -- support of links --------------------------------------------------------------

#: Edits by the length of the shorter word; segments have two letters at least (three-letter words meet among words of bodies only, for "and").
CLASSES = [(3, 1), (4, 1), (6, 2), (8, 3)]
#: How much more often the right spelling occurs than one that is itself found more than FEW times (and where both are SHORT), and than one that isn't.
FAR_MORE, FAR_MORE_SHORT, MORE, FEW, SHORT = 20, 200, 2, 2, 4
#: A surname found with so many initials is one of its own.
OWN_INITIALS = 3

def _options(given: Column, nicknames: dict[str, str]) -> Column:
    """The names a given name may stand for: itself, or those of a nickname."""
    return F.coalesce(F.element_at(_meant(nicknames), given), F.array(given))


def vocabulary(parts: DataFrame, nicknames: dict[str, str] = NICKNAMES) -> DataFrame:
    """``grp`` (role and, but for words of bodies, first letter; surnames also by the second, and by each initial beside them), ``key``, ``info`` (``n``: names it occurs in, ``initials`` beside a surname) of the words of all names.

    Roles are s (surname), g (given name), p (place), b (word of a body; link
    words count once for every body) and r (all words of a body of one place).
    """
    word = lambda role, key, initials: F.struct(F.lit(role).alias("role"), key.alias("key"), initials.alias("initials"))
    none = F.array().cast("array<string>")
    given = F.col("given")
    initials = F.when(given.isNotNull(), F.transform(_options(given, nicknames), lambda x: F.substring(x, 1, 1))).otherwise(none)
    of_person = F.when(F.length(given) > 1, F.array(word("s", F.col("key"), initials), word("g", given, none))).otherwise(F.array(word("s", F.col("key"), initials)))
    of_body = F.concat(
        F.array(word("p", F.col("key"), none), F.struct(F.concat(F.lit("r/"), F.col("key")).alias("role"), F.col("rest").alias("key"), none.alias("initials"))),
        F.transform(F.array_distinct(F.concat(F.split("rest", " "), F.array(*map(F.lit, sorted(LINKS))))), lambda w: word("b", w, none)),
    )
    rows = parts.select(F.inline(F.when(F.col("kind") == "person", of_person).otherwise(of_body))).filter("key <> ''")
    rows = rows.filter((F.col("role") == "b") | (F.length("key") > 3))
    first, second = F.substring("key", 1, 1), F.substring("key", 2, 1)  # a surname after a particle may lose or swap its first letter
    letters = F.when(F.col("role") == "b", F.array(F.lit(""))).when(F.col("role") == "s", F.array_distinct(F.array(first, second))).otherwise(F.array(first))
    rows = rows.select("role", "key", letters.alias("letters"), F.posexplode_outer("initials").alias("at", "initial"))
    names = F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1))  # a name has a row for each of its initials
    words = rows.groupBy("role", "key").agg(names.alias("n"), F.collect_set("initial").alias("initials"), F.first("letters").alias("letters"))  # initials: no more than letters
    words = words.select("role", "key", F.struct("n", "initials").alias("info"), F.explode("letters").alias("letter"), "initials")
    return words.select("role", F.explode_outer(F.when(F.col("role") == "s", F.col("initials"))).alias("initial"), "letter", "key", "info").select(F.concat_ws("/", "role", F.concat("letter", F.coalesce("initial", F.lit("")))).alias("grp"), "key", "info")


def _swapped() -> Column:
    """Two slips of which one swaps neighbours: three edits, but nearly the same letters."""
    letters = lambda c: F.array_join(F.array_sort(F.split(F.col(c), "")), "")
    return F.levenshtein(letters("a"), letters("b")) <= 2


def supported_links(vocab: DataFrame, nicknames: dict[str, str] = NICKNAMES) -> DataFrame:
    """``role``, ``key``, ``target``, ``distance``, ``n``: the links that the occurrences of both words support (see the module's text)."""
    known = sorted({*nicknames, *(name for full in nicknames.values() for name in full.split(" "))})  # no slips of other names
    met = _met_keys(vocab, CLASSES).filter((F.col("distance") < 3) | _swapped())
    up = F.struct(F.col("ia.n"), F.col("a")) < F.struct(F.col("ib.n"), F.col("b"))
    side = lambda first, second: F.when(up, F.col(first)).otherwise(F.col(second))
    met = met.select(F.regexp_extract("grp", "^(.*)/[^/]*$", 1).alias("role"), side("a", "b").alias("key"), side("b", "a").alias("target"), side("ia", "ib").alias("low"), side("ib", "ia").alias("high"), "distance")
    n, m = F.col("low.n"), F.col("high.n")
    short = F.greatest(F.length("key"), F.length("target")) <= SHORT
    far = (n * F.when(short, FAR_MORE_SHORT).otherwise(FAR_MORE) <= m) | ((n <= FEW) & (n * MORE <= m))
    surname = (F.size("low.initials") < OWN_INITIALS) | (n * FAR_MORE <= m)  # they share an initial: their group
    begins = lambda c, at: F.substring(c, at, 1)
    shifted = ((begins("key", 2) == begins("target", 1)) | (begins("key", 1) == begins("target", 2))) & (F.col("distance") <= 2) & (n <= FEW) & (n * MORE <= m)
    surname = surname & ((begins("key", 1) == begins("target", 1)) | shifted)
    spelt_out = lambda c: F.regexp_replace(c, "([aou])e(?=[^aeiouy])", "$1")  # noqa: E731  # Juergen, Jürgen
    far = far | (F.col("role") == "g") & (spelt_out("key") == spelt_out("target"))
    ended = F.startswith("key", "target") | F.startswith("target", "key")  # Daniel, Danielle
    x, y = F.split("key", " "), F.split("target", " ")
    pairs = F.when(F.size(x) == F.size(y), F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: p["x"] != p["y"]))
    role = F.col("role")
    support = F.when(role == "s", surname).when(role == "g", far & ~ended & ~F.col("key").isin(known)).when(role == "b", far).otherwise(F.lit(True))
    met = cut(met.withColumn("pairs", F.when(F.startswith(role, F.lit("r/")), pairs)).filter(support).select("role", "key", "target", "distance", "pairs", m.alias("n"), (n != m).alias("more"), (n * MORE <= m).alias("well")))
    whole = F.startswith(role, F.lit("r/"))
    glued = met.filter(whole & F.col("pairs").isNull() & (F.col("distance") <= 2))
    # a slip within words: each is one that the words' own occurrences support, or a letter more or less, or a swap, in a short word
    slips = met.filter(whole & F.col("pairs").isNotNull()).select("*", F.explode("pairs").alias("p")).select("*", "p.x", "p.y")
    words = met.filter("role = 'b'").select(F.col("key").alias("x"), F.col("target").alias("y"), F.lit(True).alias("known")).distinct()
    letters = lambda c: F.array_sort(F.split(c, ""))
    short_slip = (F.least(F.length("x"), F.length("y")) < 6) & ((letters("x") == letters("y")) | F.col("well") & (F.abs(F.length("x") - F.length("y")) == 1) & (F.levenshtein("x", "y") == 1))
    slips = slips.join(words, ["x", "y"], "left").groupBy("role", "key", "target", "distance", "n", "more").agg(F.bool_and(F.coalesce("known", F.lit(False)) | short_slip).alias("all"))
    names = ["role", "key", "target", "distance", "n", "more"]
    return met.filter(~whole).select(names).unionByName(glued.select(names)).unionByName(slips.filter("all").select(names))


def roots(links: DataFrame) -> DataFrame:
    """``role``, ``key``, ``root``: where a misspelt key leads: to the nearest target, of equally near ones to the most frequent, and to where that one leads.

    It leads to an equally frequent one only if none is more frequent; among
    equally frequent keys the one with most links is the spelling the others
    come from.
    """
    both = links.select("role", "distance", "n", "more", F.inline(F.array(F.struct(F.col("key").alias("key"), F.col("target").alias("target"), F.lit(True).alias("up")), F.struct(F.col("target").alias("key"), F.col("key").alias("target"), F.lit(False).alias("up")))))
    both = both.filter(F.col("up") | ~F.col("more")).distinct()
    degree = links.select("role", F.inline(F.array(F.struct(F.col("key").alias("key"), F.col("target").alias("of")), F.struct(F.col("target").alias("key"), F.col("key").alias("of"))))).distinct().groupBy("role", "key").agg(F.count("*").alias("links"))
    ranked = both.join(degree, ["role", "key"]).join(degree.withColumnsRenamed({"key": "target", "links": "target_links"}), ["role", "target"])
    words = lambda c: F.size(F.split(c, " ")).alias("words")  # noqa: E731  # of bodies, the one whose words aren't glued
    ranked = ranked.filter(F.col("more") | (F.struct(words("key"), "links", "key") < F.struct(words("target"), F.col("target_links").alias("links"), F.col("target").alias("key"))))
    best = F.max_by("target", F.struct("more", (-F.col("distance")).alias("near"), "n", words("target"), "target_links", "target"))
    up = cut(ranked.groupBy("role", "key").agg(best.alias("root")))
    on = up.select("role", F.col("key").alias("root"), F.col("root").alias("further"))
    return up.join(on, ["role", "root"], "left").select("role", "key", F.coalesce("further", "root").alias("root"))


def name_entities(names: DataFrame, nicknames: dict[str, str] = NICKNAMES) -> DataFrame:
    """``name``, ``kind``, ``entity`` (a hash) of every distinct name that names somebody.

    ``names`` has one column ``name``, repeated as often as it occurs.  Null, the
    empty string, blanks, Anonymous and Unknown name nobody.  A form with
    initials only goes to the person it fits if there is just one; where several
    fit it stays apart.  ``nicknames`` has the given names, by a blank, that each
    nickname may stand for.  An empty table gives no rows.
    """
    held = names.filter(F.col("name").isNotNull() & ~F.trim("name").isin(PLACEHOLDERS)).select("name").distinct()
    width = shuffle_width(names.sparkSession)
    parts = cut(settle_order(cut(parsed_names(held.repartition(width))), nicknames))  # few bytes, but dear to parse: never coalesced
    links = cut(supported_links(cut(vocabulary(parts, nicknames).repartition(width)), nicknames))  # each word becomes many segments
    settled = cut(roots(links.filter("role <> 'g'")))
    of = lambda role: settled.filter(F.col("role") == role)

    bodies = parts.filter("kind = 'body'").select("name", "kind", "key", "rest")
    whole = settled.filter(F.startswith("role", F.lit("r/"))).select(F.substr("role", F.lit(3)).alias("key"), F.col("key").alias("rest"), F.col("root").alias("body"))
    bodies = bodies.join(whole, ["key", "rest"], "left").withColumn("rest", F.coalesce("body", "rest"))
    bodies = bodies.join(of("p").select("key", F.col("root").alias("place")), "key", "left").select("name", "kind", F.coalesce("place", "key").alias("place"), "rest")
    shown = bodies.select("rest").distinct().select("rest", F.posexplode(F.split("rest", " ")).alias("at", "key"))
    shown = shown.join(of("b").select("key", "root"), "key", "left").groupBy("rest").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("root", "key").alias("word")))).alias("w"))  # the words of one name
    words = F.filter("w.word", lambda w: ~w.isin(sorted(LINKS)))
    bodies = bodies.join(shown.select("rest", F.array_join(words, " ").alias("body")), "rest").select("name", "kind", F.xxhash64("kind", "place", "body").alias("entity"))

    people = parts.filter("kind = 'person'").join(of("s").select("key", "root"), "key", "left")
    people = cut(people.select("name", "kind", F.concat_ws("/", F.coalesce("root", "key"), "generation").alias("grp"), "given", "middle"))
    spelt = people.filter(F.length("given") > 1)
    # what a given name may stand for: the right spellings of a misspelt one, the names of a nickname; of several, the one that occurs with the surname
    forms = spelt.select("grp", "given").distinct()
    near = links.filter("role = 'g'").select(F.col("key").alias("given"), "target", "distance", F.col("n").alias("known"))
    options = forms.join(near, "given", "left").select("grp", "given", F.posexplode(_options(F.coalesce("target", "given"), nicknames)).alias("pos", "option"), F.coalesce("distance", F.lit(0)).alias("distance"), F.coalesce("known", F.lit(0)).alias("known"))
    present = spelt.groupBy("grp", F.col("given").alias("option")).agg(F.count("*").alias("present"))
    order = F.struct(F.coalesce("present", F.lit(0)).alias("present"), (-F.col("distance")).alias("near"), "known", (-F.col("pos")).alias("pos"), "option")
    chosen = options.join(present, ["grp", "option"], "left").groupBy("grp", "given").agg(F.max(order).alias("c")).select("grp", "given", F.col("c.option").alias("first"))
    spelt = spelt.join(chosen, ["grp", "given"]).select("name", "kind", "grp", "first", "middle")

    # middle names: a form without one goes to the only one there is
    middles = spelt.filter("middle is not null").groupBy("grp", "first").agg(F.min("middle").alias("only"), F.max("middle").alias("last"))
    mid = F.coalesce("middle", F.when(F.col("only") == F.col("last"), F.col("only")), F.lit(""))
    spelt = cut(spelt.join(middles, ["grp", "first"], "left").select("name", "kind", "grp", "first", mid.alias("mid")))
    persons = spelt.select("grp", F.substring("first", 1, 1).alias("initial"), "first", "mid").distinct()

    # initials: a form goes to the only person it fits, by the middle initial where there is one
    short = people.filter("given is null or length(given) = 1").select("name", "kind", "grp", F.coalesce("given", F.lit("")).alias("initial"), F.coalesce("middle", F.lit("")).alias("m"))
    fits = short.select("grp", "initial", "m").distinct().join(persons, ["grp", "initial"], "left")
    fit = F.col("first").isNotNull() & ((F.col("m") == "") | (F.col("mid") == "") | (F.col("m") == F.col("mid")))
    exact = fit & (F.col("m") == F.col("mid")) & (F.col("m") != "")
    person = F.struct("first", "mid")
    counted = [F.count(F.when(c, 1)).alias(f"n_{x}") for x, c in (("fit", fit), ("exact", exact))] + [F.min(F.when(c, person)).alias(f"p_{x}") for x, c in (("fit", fit), ("exact", exact))]
    placed = fits.groupBy("grp", "initial", "m").agg(*counted)
    only = F.when(F.col("n_exact") == 1, F.col("p_exact")).when((F.col("n_exact") == 0) & (F.col("n_fit") == 1), F.col("p_fit"))
    placed = cut(placed.select("grp", "initial", "m", only.alias("p")))
    # forms that fit nobody spelt out stand for themselves; the one without a middle initial goes to the only one with
    alone = placed.filter("p is null and m <> ''").groupBy("grp", "initial").agg(F.min("m").alias("one"), F.max("m").alias("other"))
    mid = F.when((F.col("m") == "") & (F.col("one") == F.col("other")), F.col("one")).otherwise(F.col("m"))
    placed = placed.join(alone, ["grp", "initial"], "left").select("grp", "initial", "m", F.coalesce("p.first", F.concat("initial", F.lit("."))).alias("first"), F.when(F.col("p").isNull(), mid).otherwise(F.col("p.mid")).alias("mid"))
    short = short.join(placed, ["grp", "initial", "m"]).select("name", "kind", "grp", "first", "mid")
    persons = spelt.unionByName(short).select("name", "kind", F.xxhash64("kind", "grp", "first", "mid").alias("entity"))
    return persons.unionByName(bodies)


def name_pairs(entities: DataFrame) -> DataFrame:
    """``name_a``, ``name_b`` (a before b) of every two names of one entity: the links asked for."""
    a = entities.select("entity", F.col("name").alias("name_a"))
    b = entities.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")


def entity_classes(entities: DataFrame) -> DataFrame:
    """One row per name: ``name``, ``entity`` and ``links``, the number of other names of its entity."""
    return entities.select("name", "entity", (F.count("*").over(W.partitionBy("entity")) - 1).alias("links"))
