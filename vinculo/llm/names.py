"""Variant spellings of names typed by people (problem 5): a pigeonhole segment join over the parts of names.

A name is read into parts: titles, legal forms, bracketed remarks and invisible characters go; first names and
descriptors (``Logistics``, ``Growth Fund``) are told from the surname or coined words by where they stand among all
names of the label: a first name seldom stands last, a descriptor seldom first. That is a share of places, so it doesn't
depend on how many names there are.

Parts are then joined within k edits. A part is looked for only among names that agree in another part (surnames beside
one first name, first names beside one surname, coined words beside one descriptor, descriptors beside the same coined
words): this is its block. Each part is cut into k + r segments; k edits spoil at most k of them, so the rest is found
in an inverted index by (block, length, spoilt segments, rest), at the places that the edits allow (r = 1 is the plain
form with k + 1 segments; more texts take a larger r, whose longer rests keep the hits few; the result is the same).
Hits are verified by a banded edit distance, in short parts with a swap of neighbours as one edit. Equal parts are the
hits without an edit. The links make groups by the grid components.

A name that leaves something out (initial for a first name, no descriptor, initials of descriptors) joins the one group
that answers to what it states, and none if there are several.

Rows with a null id, label or name, and names without a letter, have no links. Every pair of nodes of a group comes
out, equal names included.
"""

from __future__ import annotations

import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, lookup
from .components import components
from .strings import INVISIBLE, fold

#: A word is a first name or descriptor if beside so many different words, and in so large a share of its places.
COMMON_LEAST, GIVEN_SHARE, DESCRIPTOR_SHARE = 5, 0.6, 0.8
#: One that stands beside so many times fewer words than another near it, or begun by it, is a typo or beginning of that.
RARER = 8
#: Lengths from which a part and a single word may have one edit, and two.
EDITS, TOKEN_EDITS = (5, 8), (3, 7)
#: Texts of a join above which its signatures take one more segment; sets only the work.
SPARE_STEPS = (1_000_000, 100_000_000)
#: Rows of one key of a join above which they are dealt out to several tasks; sets only their size.
KEY_ROWS = 20_000
#: Members of a group that one task pairs with all others.
PAIR_ROWS = 1_000
# Forms and titles that identify nobody, usual words of firm names and their short forms, nicknames.
LEGAL = set("inc incorporated llc llp lp ltd limited gmbh ag kg co corp corporation sa sarl srl spa plc bv nv oy ab as aps pty kk the".split())
COMPANY_TAILS = set("group technologies technology startup hq company".split())
TAILS = {w for w in LEGAL | COMPANY_TAILS if len(w) > 6}
TITLES = set("mr mrs ms miss dr prof professor sir dame jr sr phd md herr frau".split())
DESCRIPTORS = set(
    "logistics analytics health software studios robotics systems energy security mobility foods labs capital partners ventures holdings angels fund growth seed equity group investment management opportunity "
    "solutions networks media consulting services industries bank insurance biotech pharma motors airlines advisors associates".split()
)
SHORT_WORDS = {"sw": "software", "vc": "ventures", "mgmt": "management", "hldgs": "holdings", "laboratories": "labs", "laboratory": "labs", "tech": "technologies", "ptnrs": "partners", "intl": "international", "grp": "group", "eq": "equity", "angel": "angels"}
NICKNAMES = {
    n: full
    for full, names in {
        "abigail": "abby gail", "alexander": "alex sasha sandy", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny", "christopher": "chris kit topher", "daniel": "dan danny", "deborah": "deb debbie",
        "edward": "ed eddie ted ned", "elizabeth": "liz beth betty eliza lizzie", "francesca": "fran frankie", "frederick": "fred freddy", "gabriella": "gabby gaby ella", "gregory": "greg", "isabella": "bella izzy", "jennifer": "jen jenny",
        "jonathan": "jon", "joshua": "josh", "josephine": "josie jo", "katherine": "kate kathy kat katie", "leonard": "leo len lenny", "margaret": "maggie meg peggy", "matthew": "matt", "maximilian": "max", "michael": "mike mick",
        "nathaniel": "nate nathan", "nicholas": "nick nico", "patricia": "pat trish patty", "philippa": "pippa pip", "raymond": "ray", "rebecca": "becca becky", "robert": "bob rob bobby", "samantha": "sam", "stephanie": "steph", "susanna": "sue susie",
        "theodore": "theo ted teddy", "thomas": "tom tommy", "timothy": "tim", "valentina": "val", "victoria": "vicky tori", "william": "bill will billy liam", "zachary": "zach zack", "gustavo": "gus", "valentine": "val", "richard": "rick dick", "james": "jim jimmy", "john": "jack johnny",
        "charles": "charlie chuck", "joseph": "joe", "lawrence": "larry", "gerald": "jerry", "henry": "harry hank", "peter": "pete", "steven": "steve", "kenneth": "ken", "ronald": "ron", "donald": "don", "eugene": "gene", "dorothy": "dot", "virginia": "ginny",
    }.items()
    for n in names.split()
}
#: Descriptors that say nothing beside others.
GENERIC = {"group", "fund"}
#: Nicknames of a second name; such a person is read both ways.
SECOND = {"ted": "edward", "ned": "edmund", "chris": "christina", "alex": "alexandra", "sam": "samuel", "jo": "joanna", "steph": "stephen", "val": "valerie valentina", "kit": "katherine", "pat": "patrick", "nat": "natalie", "tom": "tomas"}
FULL = set(NICKNAMES.values())
ROMAN = re.compile(r"^(?=[ivx])(x{0,3}(ix|iv|v?i{0,3}))$")
DOTTED = re.compile(r"\b(s\.\s?a\.\s?r\.\s?l|s\.\s?a\.?\s?r\.?\s?l|s\.\s?a|l\.\s?p|l\.\s?l\.\s?c|s\.\s?r\.\s?l|b\.\s?v|n\.\s?v)\b\.?", re.I)
BRACKETS = re.compile(r"\([^)]*\)?|\[[^\]]*\]|[™®©]")
CAMEL = re.compile(r"(?:[A-Z][a-z]{2,}){2,}")



def words_of(name: str) -> list[str]:
    """The folded words of a name without brackets, signs and dotted legal forms; joined words are parted at capitals."""
    name = INVISIBLE.sub("", BRACKETS.sub(" ", name))
    name = DOTTED.sub(" ", name)
    name = re.sub(r"[^\W\d_]+", lambda m: re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[0]) if CAMEL.fullmatch(m[0]) else m[0], name)
    return [w for w in re.split(r"[\W_]+", fold(name.replace("'", "").replace("’", ""))) if w and w != "and"]


def split_name(label: str, name: str) -> tuple[list[str], int]:
    """The words of a name in usual order, and how many of the last are a surname by a comma (0 if nothing tells)."""
    if label == "Founder":
        comma = re.match(r"\s*([^,]+),\s*([^,]+)$", BRACKETS.sub(" ", name))
        if comma:
            last, rest = words_of(comma[1]), [w for w in words_of(comma[2]) if w not in TITLES]
            if last and rest:
                return rest + last, len(last)
        return [w for w in words_of(name) if w not in TITLES], 0
    drop = LEGAL | COMPANY_TAILS if label == "Company" else LEGAL
    words = words_of(name)
    return [w for w in words if w not in drop] or words, 0


def _skeleton(short: str, word: str) -> bool:
    rest = iter(word)
    return short[0] == word[0] and all(c in rest for c in short)


def descriptor(word: str) -> str | None:
    """The descriptor that a word is or shortens, of those that every list of firms has."""
    if word in DESCRIPTORS:
        return word
    if word in SHORT_WORDS:
        return SHORT_WORDS[word]
    if len(word) < 3:
        return None
    fits = [d for d in DESCRIPTORS if d.startswith(word)]
    if not fits and not re.search("[aeiou]", word[1:]):
        fits = [d for d in DESCRIPTORS if _skeleton(word, d)]
    return fits[0] if len(fits) == 1 else None


def read_person(words: list[str], meant: list[tuple[str, int] | None], tail: int) -> list[dict]:
    """The readings of a person's name: usually one, two for a nickname of two names.

    ``meant`` has for each word the first name that it is or, some edits apart, may be.
    """
    if not words or len(words) == 1 and len(words[0]) < 2:
        return []
    known = [w in NICKNAMES or w in FULL or len(w) == 1 or m is not None and not m[1] for w, m in zip(words, meant)]
    near = {w: m[0] for w, m in zip(words, meant) if m}
    if len(words) == 1:
        first, middle, last = "", "", words
    elif tail:
        first, middle, last = words[0], "".join(words[1:-tail][:1]), words[-tail:]
    else:
        likely = list(known)
        for i, w in enumerate(words):  # first names with a typo; not a part of a surname
            placed = i == 0 or i == len(words) - 1 and not known[0] or len(w) > 5
            likely[i] |= likely.count(False) > 1 and placed and w in near
        if all(likely):
            likely[-1] = False
        if not likely[0] and (not any(likely) or not likely[-1] and any(likely)):
            likely[0] = True
        end = len(words)
        while end and likely[end - 1]:
            end -= 1
        start = 0
        while start < end and likely[start]:
            start += 1
        if start and end < len(words) and all(len(w) == 1 for w in words[end:]):  # an initial behind the surname is a middle one
            words = words[:start] + words[end:] + words[start:end]
            start, end = start + len(words) - end, len(words)
        last = [w for w in words[start:end] if len(w) > 1] or words[start:end]
        rest = words[:start] + words[end:]
        if not rest:
            return []
        first, middle = rest[0], "".join(rest[1:2])
    core = "".join(last)
    out = []
    for full in dict.fromkeys([NICKNAMES.get(first) or near.get(first, first), *SECOND.get(first, "").split()]):
        begun = 0 < len(full) < 4 and full not in FULL and first not in near
        views = [("V", f"1|{full}", core, 3, 0)]
        if begun:
            views += [("V", f"3|{full}", core, 1, 1), ("O", f"3|{full}", core, 0, 0)]
        elif full:
            if first not in near and first not in NICKNAMES:
                views.append(("V", f"2|{core}", full, 3, 0))
            views += [(kind, f"3|{full[:n]}", core, role, 1) for n in (1, 2, 3) if len(full) > n for kind, role in (("V", 2), ("K", 0))]
        out.append({"core": core, "beside": "", "first": full, "middle": NICKNAMES.get(middle) or near.get(middle, middle), "views": views})
    return out


def read_firm(words: list[str], meant: list[tuple[str, int] | None], numbered: bool) -> list[dict]:
    """The readings of a firm's name: coined words, descriptors, number and an initial for a coined word."""
    core, typed, number = [], [], ""
    for i, (w, m) in enumerate(zip(words, meant)):
        if i and numbered and not number and ROMAN.match(w):
            number = w
            continue
        d = (descriptor(w) or m and m[0]) if len(words) > 1 else None
        if d in TAILS and len(core) + len(typed) + len(words) - i > 1:
            continue
        if d:
            typed += [x for x in d.split() if x not in typed]
        else:
            core.append(w)
    if not core:
        core, typed = [w for w in words if w != number] or words, []
    if len(core) == 1 and not typed:
        cut = next((d for d in sorted(DESCRIPTORS, key=len, reverse=True) if core[0].endswith(d) and len(core[0]) - len(d) > 3), None)
        if cut:
            core, typed = [core[0][: -len(cut)]], [cut]
    initials = [w for w in core if len(w) == 1] if numbered else []
    wordy = [w for w in core if len(w) > 1 or not numbered]
    if not wordy:
        return []
    first = initials[0] if len(initials) == 1 and len(wordy) == 1 else ""
    said = sorted(set(typed) - GENERIC) or sorted(typed)
    beside, joined = " ".join(said), "".join(wordy)
    texts = dict.fromkeys([joined, "".join(sorted(wordy))])
    views = [("V", f"1|{beside}|{number}|{first}", t, 3, 0) for t in texts]
    if first:
        views.append(("O", f"4|{beside}|{number}|{first}", wordy[0], 0, 0))
    else:
        if len(wordy) == 2:
            views += [("K", f"4|{beside}|{number}|{a[0]}", b, 0, 0) for a, b in (wordy, wordy[::-1])]
        # a name with fewer of the descriptors joins the only one that has them all
        views += [("O", f"3|{beside}|{number}", t, 0, 0) for t in texts]
        if typed or number:
            views += [("K", "3||", t, 0, 0) for t in texts]
        if 1 < len(said) < 5:
            fewer = [" ".join(x) for n in range(1, len(said)) for x in itertools.combinations(said, n)]
            views += [("K", f"3|{x}|{number}", t, 0, 0) for x in fewer for t in texts]
        if len(typed) > 1:
            views += [("K", f"5|{number}|{''.join(x[0] for x in typed)}", t, 0, 0) for t in texts]
        if len(wordy) > 1 and len(wordy[-1]) < 4 and not typed:
            views.append(("O", f"5|{number}|{wordy[-1]}", "".join(wordy[:-1]), 0, 0))
    return [{"core": joined, "beside": f"{beside}|{number}", "first": first, "middle": "", "views": views}]


def common_words(words: DataFrame) -> DataFrame:
    """``label, word, n`` of first names and descriptors, from the ``label, words`` of distinct names."""
    person = F.col("label") == "Founder"
    several = words.select("label", F.filter("words", lambda w: F.length(w) > 1).alias("ws")).where("size(ws) > 1")
    # the places of a name: the last against the others for persons, the first against the others for firms
    far = F.when(person, F.element_at("ws", -1)).otherwise(F.get("ws", F.lit(0)))
    near = F.when(person, F.get("ws", F.lit(0))).otherwise(F.get("ws", F.lit(1)))
    at = F.when(person, F.size("ws") - 1).otherwise(F.lit(0))
    places = several.select("label", F.posexplode("ws").alias("i", "word"), at.alias("at"), far.alias("far"), near.alias("near"))
    places = places.select("label", "word", (F.col("i") == F.col("at")).alias("head"), F.when(F.col("i") == F.col("at"), F.col("near")).otherwise(F.col("far")).alias("other")).distinct()
    seen = places.groupBy("label", "word").agg(F.sum((~F.col("head")).cast("long")).alias("n"), F.count("*").alias("all"))
    share = F.when(person, F.lit(GIVEN_SHARE)).otherwise(F.lit(DESCRIPTOR_SHARE))
    return seen.where((F.col("n") >= COMMON_LEAST) & (F.col("n") >= share * F.col("all"))).where(person | F.col("word").rlike("^[a-z]{4,}$")).select("label", "word", "n")


def meanings(words: DataFrame) -> DataFrame:
    """``key, meant, d``: of each distinct word (``label word``) the first name or descriptor it is or has a typo of."""
    usual = [("Founder", w) for w in sorted(FULL)] + [(label, w) for label in ("Company", "Investor") for w in sorted(DESCRIPTORS | TAILS)]
    usual = words.sparkSession.createDataFrame(usual, "label string, word string").withColumn("usual", F.lit(True))
    known = durable(common_words(words).join(usual, ["label", "word"], "full").select("label", "word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("usual", F.lit(False)).alias("usual")))
    tokens = words.where("size(words) > 1").select("label", F.explode("words").alias("word")).where("length(word) > 3").distinct()
    both = tokens.withColumn("role", F.lit(1)).unionByName(known.select("label", "word", F.lit(2).alias("role")))
    texts = durable(both.groupBy(F.col("label").alias("block"), F.col("word").alias("text")).agg(F.expr("bit_or(role)").alias("role"), F.lit(1).alias("up")))
    near = durable(segment_pairs(texts, bounds=TOKEN_EDITS))
    own = known.select(F.col("label").alias("block"), F.col("word").alias("a"), F.col("n").alias("own"), "usual")
    more = known.select(F.col("label").alias("block"), F.col("word").alias("b"), F.col("n").alias("more"))
    pairs = durable(near.join(more, ["block", "b"]).join(own, ["block", "a"], "left"))
    rarer = "not usual and more >= own * " + str(RARER)
    shorts = more.where("block = 'Founder' and length(b) > 3").select("block", "more", F.explode(F.array(F.substring("b", 1, 2), F.substring("b", 1, 3))).alias("a")).groupBy("block", "a").agg(F.max("more").alias("more"))
    begun = own.where("length(a) < 4").join(shorts, ["block", "a"]).where(rarer).select("block", "a")
    wrong = durable(pairs.where(rarer).select("block", "a").unionByName(begun).distinct())
    typos = pairs.where("own is null or " + rarer).join(wrong.withColumnRenamed("a", "b"), ["block", "b"], "left_anti")
    typos = typos.groupBy("block", "a").agg(F.min(F.struct("d", (-F.col("more")).alias("o"), F.col("b").alias("meant"))).alias("m")).select("block", "a", "m.meant", "m.d")
    right = own.join(wrong, ["block", "a"], "left_anti").select("block", "a", F.col("a").alias("meant"), F.lit(0).alias("d"))
    return right.unionByName(typos).select(F.concat_ws(" ", "block", "a").alias("key"), "meant", "d")


VIEW = "array<struct<kind:string,block:string,text:string,role:int,up:int>>"


def read_names(nodes: DataFrame) -> DataFrame:
    """``label, name, core, beside, first, middle, views`` for each distinct name of a label; a few have two readings."""
    conf = nodes.sparkSession.conf
    # few bytes but much work a row: as many tasks as the cluster runs, whatever the bytes
    spread = max(nodes.sparkSession.sparkContext.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")))
    names = nodes.select("label", "name").distinct().repartition(spread)

    def cut(batches):
        for pdf in batches:
            both = [split_name(label, name) for label, name in zip(pdf["label"], pdf["name"])]
            yield pdf.assign(words=[b[0] for b in both], tail=[b[1] for b in both])

    words = names.mapInPandas(cut, "label string, name string, words array<string>, tail int").where("size(words) > 0")
    numbered = durable(words.withColumn("id", F.monotonically_increasing_id()))
    single = numbered.select("id", F.posexplode("words").alias("i", "w"), "label").select("id", "i", F.concat_ws(" ", "label", "w").alias("key"))
    # one word may stand in a third of all names
    meant = lookup(durable(single), durable(meanings(numbered)), "key", "inner").groupBy("id").agg(F.collect_list(F.struct("i", "meant", "d")).alias("meant"))

    def run(batches):
        for pdf in batches:
            rows = []
            for label, name, ws, tail, meant in zip(pdf["label"], pdf["name"], pdf["words"], pdf["tail"], pdf["meant"]):
                at = {} if meant is None else {m["i"]: (m["meant"], m["d"]) for m in meant}
                each = [at.get(i) for i in range(len(ws))]
                found = read_person(list(ws), each, tail) if label == "Founder" else read_firm(list(ws), each, label != "Company")
                rows += [(label, name, r["core"], r["beside"], r["first"], r["middle"], r["views"]) for r in found]
            yield pd.DataFrame(rows, columns=["label", "name", "core", "beside", "first", "middle", "views"])

    return numbered.join(meant, "id", "left").drop("id").repartition(spread).mapInPandas(run, f"label string, name string, core string, beside string, first string, middle string, views {VIEW}")


def _allowed(n: Column, bounds: tuple[int, int]) -> Column:
    return F.when(n < bounds[0], 0).when(n < bounds[1], 1).otherwise(2)


def _signatures(rows: DataFrame, spare: int, m: Column, bounds: tuple[int, int], *, probing: bool) -> DataFrame:
    """``rows`` (with ``t``) by every choice of k spoilt segments of a text of length ``m``: ``i, j, sig``.

    ``sig`` is what stands outside them. An index has t itself as that text; a probe's t comes from it by edits, so
    what follows the first edit is shifted, and what follows both by the difference of the lengths.
    """
    n = F.length("t")
    shift = n - m
    rows = rows.withColumn("k", _allowed(m, bounds)).where("k > 0")
    k = F.col("k")
    picks = [F.array(*[F.struct(F.lit(s[0]).alias("i"), F.lit(s[-1]).alias("j")) for s in itertools.combinations(range(e + spare), e)]) for e in (1, 2)]
    rows = rows.select("*", F.inline(F.when(k == 1, picks[0]).otherwise(picks[1])))
    i, j = F.col("i"), F.col("j")
    between = j > i + 1
    if probing:
        moved = F.when(~between, F.array(F.lit(0))).when(shift == 0, F.array(F.lit(-1), F.lit(0), F.lit(1))).otherwise(F.sequence(F.least(F.lit(0), shift), F.greatest(F.lit(0), shift)))
        rows = rows.withColumn("by", F.explode(moved))
    else:
        rows = rows.withColumn("by", F.lit(0))
    cut = lambda s: (s * m / (k + spare)).cast("int")
    part = lambda a, b: F.when((b > a) & (a >= 0), F.substring("t", a + 1, b - a)).otherwise(F.lit(""))
    # one edit may be a swap, which reaches a letter into the next segment
    swap = F.when(k == 1, 1).otherwise(0)
    sig = F.concat_ws("\x01", part(F.lit(0), cut(i)), F.when(between, part(cut(i + 1) + F.col("by"), cut(j) + F.col("by"))), part(cut(j + 1) + swap + shift, n))
    return rows.withColumn("sig", sig).drop("by")


def distance(a: Column, b: Column, k: Column) -> Column:
    """The banded edit distance of two texts if it is at most k, else null; a single swap of neighbours is one edit."""
    swapped = F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda p: F.concat(F.substring(a, F.lit(1), p - 1), F.substring(a, p + 1, F.lit(1)), F.substring(a, p, F.lit(1)), F.substring(a, p + 2, F.length(a))) == b)
    two = F.levenshtein(a, b, 2)
    return F.when((two == 2) & (F.length(a) == F.length(b)) & swapped, F.lit(1)).when((two >= 0) & (two <= k), two)


def segment_pairs(texts: DataFrame, spare: int | None = None, bounds: tuple[int, int] = EDITS) -> DataFrame:
    """``block, a, b, d`` of different texts of one block within the edits that the length of b allows.

    ``texts`` has ``block, text, role, up``, distinct and stored. A role of 1 probes, of 2 is in the index, of 3 both; b is
    in the index. Texts that all have role 3 and ``up`` 0 look for shorter or equally long ones only and so come out
    once, a before b; with ``up`` 1 a probe looks for longer ones too.
    """
    size = texts.groupBy("block").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("all"), F.coalesce(F.max("c"), F.lit(0)).alias("most")).first()
    if spare is None:
        spare = 1 + sum(size["all"] > step for step in SPARE_STEPS)
    rows = texts.select("block", F.col("text").alias("t"), "role", "up", F.length("text").alias("m")).where("m > 2")
    index = _signatures(rows.where("role >= 2").select("block", "t", "m"), spare, F.col("m"), bounds, probing=False)
    probe = rows.where("role in (1, 3)").select("block", "t", "up", F.explode(F.sequence(F.greatest(F.col("m") - 2, F.lit(3)), F.col("m") + 2 * F.col("up"))).alias("m"))
    probe = probe.where(F.abs(F.length("t") - F.col("m")) <= _allowed(F.col("m"), bounds))
    probe = _signatures(probe, spare, F.col("m"), bounds, probing=True)
    key = F.xxhash64("block", "m", "i", "j", "sig").alias("key")
    left = probe.select(key, "block", F.col("t").alias("a"), "up", "k")
    right = index.select(key, "block", F.col("t").alias("b"))
    # no key has more texts than its block
    hits = (dealt_join(left, right, "key") if size["most"] > KEY_ROWS else left.join(right, ["key", "block"])).where(F.col("a") != F.col("b")).where((F.col("up") == 1) | (F.length("a") > F.length("b")) | (F.col("a") < F.col("b")))
    hits = hits.withColumn("d", distance(F.col("a"), F.col("b"), F.col("k"))).where("d is not null")
    return hits.select("block", "a", "b", "d").distinct()


def dealt_join(left: DataFrame, right: DataFrame, key: str, rows: int = KEY_ROWS) -> DataFrame:
    """An inner join on ``key`` and ``block``; the right rows of a key that has very many are dealt out over several tasks."""
    many = durable(right.groupBy(key).agg(F.count("*").alias("c")).where(F.col("c") > rows).select(key, F.ceil(F.col("c") / rows).cast("int").alias("parts")))
    if many.isEmpty():
        return left.join(right, [key, "block"])
    left, right = (lookup(durable(side), many, key) for side in (left, right))
    one = F.coalesce("parts", F.lit(1))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    return left.join(right.withColumn("part", F.pmod(F.xxhash64("b"), one).cast("int")).drop("parts"), [key, "block", "part"]).drop("part")


def _fit(a: Column, b: Column) -> Column:
    """Whether two middle names, or initials of some, can be one."""
    return (a == "") | (b == "") | (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & ((F.length(a) == 1) | (F.length(b) == 1) | (F.levenshtein(a, b, 2) >= 0))


def strict_links(views: DataFrame) -> DataFrame:
    """``u, v`` of profiles that agree in all parts but for typos; ``views`` are ``id, middle, kind, block, text, role, up``.

    Persons of one name are one, unless all of them have middle names and these don't fit.
    """
    whole = views.where("kind = 'V'")
    own = whole.where("block like '1|%'")
    heads = own.groupBy("label", "block", "text").agg(F.min("id").alias("head"), F.max((F.col("middle") == "").cast("int")).alias("open"))
    mid = own.groupBy("label", "block", "text", F.substring("middle", 1, 1).alias("mi")).agg(F.min_by("id", F.struct(-F.length("middle"), "middle", "id")).alias("v"), F.min_by("middle", F.struct(-F.length("middle"), "middle")).alias("mm"))
    equal = own.withColumn("mi", F.substring("middle", 1, 1)).join(heads, ["label", "block", "text"]).join(mid, ["label", "block", "text", "mi"])
    equal = equal.select(F.col("id").alias("u"), F.when(F.col("open") == 1, F.col("head")).when(_fit(F.col("middle"), F.col("mm")), F.col("v")).alias("v")).where("u <> v")
    same = equal.unionByName(mid.join(heads, ["label", "block", "text"]).where("open = 1 and v <> head").select(F.col("v").alias("u"), F.col("head").alias("v")))
    # block 3 belongs to the names that leave something out
    blocked = whole.withColumn("block", F.concat_ws("#", "label", "block"))
    texts = durable(blocked.groupBy("block", "text").agg(F.expr("bit_or(role)").alias("role"), F.max("up").alias("up")))
    near = durable(segment_pairs(texts))
    who = blocked.where("block not like '%#3|%'").groupBy("block", "text", F.substring("middle", 1, 1).alias("mi")).agg(F.min_by("id", F.struct(-F.length("middle"), "middle", "id")).alias("id"), F.min_by("middle", F.struct(-F.length("middle"), "middle")).alias("middle"))
    who = durable(who)
    a = near.join(who.select("block", F.col("text").alias("a"), F.col("id").alias("u"), F.col("middle").alias("m1")), ["block", "a"])
    ab = a.join(who.select("block", F.col("text").alias("b"), F.col("id").alias("v"), F.col("middle").alias("m2")), ["block", "b"])
    typos = ab.where(F.col("u") != F.col("v")).where(_fit(F.col("m1"), F.col("m2"))).select("u", "v")
    return same.unionByName(typos), near.where("block like '%#3|%'")


def attached(views: DataFrame, groups: DataFrame, near: DataFrame) -> DataFrame:
    """``group, into``: groups that leave something out and the one group that answers to it.

    Answers are sought under exactly what is stated and, where there is none, a typo beside it. Only the least and the
    greatest group of an answer are kept, so a hot one is no hot task.
    """
    with_group = durable(views.where("kind in ('O', 'K')").join(groups, "id").select("label", "kind", F.concat_ws("#", "label", "block").alias("block"), "text", F.substring("middle", 1, 1).alias("mi"), "group"))
    bounds = [F.min("group").alias("lo"), F.max("group").alias("hi")]
    answers = durable(with_group.where("kind = 'K'").groupBy("block", "text", "mi").agg(*bounds))
    opens = with_group.where("kind = 'O'").select("block", "text", "mi", "group").distinct()
    fits = (F.col("mi") == "") | (F.col("m2") == "") | (F.col("mi") == F.col("m2"))
    exact = opens.join(answers.withColumnRenamed("mi", "m2"), ["block", "text"]).where(fits).select("group", "lo", "hi", F.lit(0).alias("d"))
    slips = near.where("d = 1").select("block", F.col("a").alias("text"), "b")
    beside = opens.join(slips, ["block", "text"]).join(answers.select("block", F.col("text").alias("b"), F.col("mi").alias("m2"), "lo", "hi"), ["block", "b"]).where(fits).select("group", "lo", "hi", F.lit(1).alias("d"))
    found = exact.unionByName(beside).where("lo <> group or hi <> group").groupBy("group", "d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    best = found.groupBy("group").agg(F.min_by(F.struct("lo", "hi"), "d").alias("c"))
    return best.where("c.lo = c.hi").select("group", F.col("c.lo").alias("into"))


def members(nodes: DataFrame) -> DataFrame:
    """``node_id, group``: nodes of one entity have one group; a node with several readings may stand in several rows."""
    nodes = durable(nodes.where("node_id is not null and label is not null and name is not null").select("node_id", "label", "name").distinct())
    cols = ["label", "core", "beside", "first", "middle"]
    read = durable(read_names(nodes))
    profiles = durable(read.groupBy(*cols).agg(F.max("views").alias("views")).withColumn("id", F.monotonically_increasing_id()))
    views = durable(profiles.select("id", "label", "beside", "middle", F.inline("views")))
    strict, near = strict_links(views)
    # all readings of a name are one entity
    named = durable(read.select("name", *cols).join(profiles.select("id", *cols), cols).select(F.concat_ws("\n", "label", "name").alias("key"), "id"))
    readings = named.groupBy("key").agg(F.min("id").alias("u"), F.collect_set("id").alias("ids")).select("u", F.explode("ids").alias("v")).where("u <> v")
    roots = components(strict.unionByName(readings))
    groups = durable(profiles.select("id").join(roots.withColumnRenamed("v", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("group")))
    into = durable(attached(views, groups, near))
    # one that leaves out two things joins over one that leaves out one; two may answer to each other
    then = into.select(F.col("group").alias("into"), F.col("into").alias("then"))
    ends = into.join(then, "into", "left").select("group", F.when(F.col("then") == F.col("group"), F.least("group", "into")).otherwise(F.coalesce("then", "into")).alias("root"))
    final = groups.join(ends, "group", "left").select("id", F.coalesce("root", "group").alias("group"))
    by_name = durable(named.join(final, "id").groupBy("key").agg(F.min("group").alias("group")))
    keyed = durable(nodes.select("node_id", F.concat_ws("\n", "label", "name").alias("key")))
    # one name may be a third of all nodes
    return durable(lookup(keyed, by_name, "key", "inner").select("node_id", "group").distinct())


def class_rows(own: DataFrame) -> DataFrame:
    """``node_id, class_id, links`` of the rows of ``members``."""
    sizes = durable(own.groupBy("group").agg(F.min("node_id").alias("class_id"), F.count("*").alias("n")))
    rows = lookup(own, sizes, "group", "inner").select("node_id", "class_id", (F.col("n") - 1).alias("links"))
    return rows.groupBy("node_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))


def pairs(own: DataFrame) -> DataFrame:
    """``node_id1, node_id2`` of the rows of ``members``; each task pairs a part of a large group's nodes with all of them."""
    sizes = durable(own.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group", F.ceil(F.col("n") / PAIR_ROWS).cast("int").alias("parts")))
    own = durable(lookup(own, sizes, "group", "inner"))
    left = own.select("group", F.col("node_id").alias("node_id1"), F.pmod(F.xxhash64("node_id"), F.col("parts")).cast("int").alias("part"))
    right = own.select("group", F.col("node_id").alias("node_id2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return left.join(right, ["group", "part"]).where("node_id1 < node_id2").select("node_id1", "node_id2").distinct()


def classes(nodes: DataFrame) -> DataFrame:
    """``node_id, class_id, links``: of each named node the smallest node of its entity and with how many others it is linked."""
    return class_rows(members(nodes))


def variants(nodes: DataFrame) -> DataFrame:
    """``node_id1, node_id2`` of all nodes that mean the same entity of one label, each pair once, smaller id first."""
    return pairs(members(nodes))
