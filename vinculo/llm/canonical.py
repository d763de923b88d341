"""Mapping free-entered values to a reference list (problem 2): token-level repair, then soft TF-IDF.

1. The distinct values are folded and cut into tokens; a value without its separators counts as one more token.
2. Each distinct token is joined to the vocabulary of the reference list (its tokens, entries and aliases without
   separators) by edit distance over an inverted index of segments; shortened tokens match by their beginning or by
   their skeleton of consonants.
3. The repaired tokens of a value are combined: each entry is ranked by soft TF-IDF, where a token that repairs to
   nothing weighs in full, words that say nothing (``industry``, ``platform``) not at all, so entries need all that is
   meant and values all that is listed. The best entry above the threshold is the answer; a tie is none.

The reference list is a fixed table; its size is checked before it goes to the workers.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import durable, lookup
from .strings import SegmentIndex, fold

#: The reference list is sent to every worker, so it may not be larger than this.
MAX_ENTRIES = 100_000
THRESHOLD, SURE, TIE = 0.80, 0.93, 0.004
#: What an unexplained word of NOISE adds to the squared length of a value, and what a fitting country adds to a city's score.
NOISE_WEIGHT, COUNTRY_BONUS = 0.5, 0.06
# Words that add nothing to what a value means, and values that say nothing.
NOISE = set(
    "the a an of and & in for industry industries sector space vertical startup startups company companies related b2b b2c saas market business area field tech-enabled solutions "
    "platform platforms framework stack open source tool library sdk software engine version v "
    "hq headquarters headquarter office area region greater metro metropolitan near downtown central city-centre centre center district outskirts suburbs around "
    "republic rep kingdom federal federation state".split()
)
NOTHING = set(
    "na n/a none null nil nan unknown tbd tba tbc misc various other others xx xxx x test todo same as above see website not given none given not known not available anywhere remote distributed hq worldwide global international emea apac".split()
)
SHORT_FORMS = {"db": "database", "svcs": "services", "svc": "service", "mgmt": "management", "intl": "international", "mt": "mount", "st": "saint", "ft": "fort", "pt": "port", "n": "north", "s": "south", "sw": "software", "hw": "hardware", "tech": "technology", "e": "east", "w": "west", "upr": "upper", "nw": "new"}
NOTHING_PHRASES = {"same as above", "see website", "not given", "none given", "not known", "not available", "n a", "to be defined", "to be added", "all over"}
COUNTRY_CUT = re.compile(r"\s*[,;(/|]\s*|\s+[-–—]\s+")
SPLIT = re.compile(r"[^\w]+|_+")
VOWEL = re.compile(r"[aeiou]")
VERSION = re.compile(r"v?\d+(\.\d+)*")


def edits(length: int) -> int:
    """How many edits a token of this length may differ by."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 11 else 3


def tokens(value: str) -> list[str]:
    return [t for t in SPLIT.split(fold(value)) if t]


def compact(value: str) -> str:
    return "".join(tokens(value))


def _within(short: str, word: str) -> bool:
    """Whether the letters of a short form stand in the word in this order."""
    rest = iter(word)
    return all(c in rest for c in short)


def caps_of(value: str) -> bool:
    """Whether a value is written like initials."""
    letters = re.sub(r"[^\w]", "", value)
    return 2 < len(letters) < 7 and letters.isupper()


@dataclass
class Entry:
    """One way to write a reference item."""

    ref_id: int
    words: list[str]
    joined: str
    items: list[int] = field(default_factory=list)


class Matcher:
    """The vocabulary of one kind of reference items; made once in each worker."""

    def __init__(self, items: list[tuple[int, str, list[str]]]):
        forms: dict[str, Entry] = {}
        for ref_id, name, aliases in items:
            for form in [name, *(aliases or [])]:
                if form and (joined := compact(form)):
                    e = forms.setdefault(joined, Entry(ref_id, tokens(form), joined))
                    if ref_id not in e.items:
                        e.items.append(ref_id)
        self.forms = forms
        self.by_word: dict[str, list[str]] = defaultdict(list)
        for e in forms.values():
            for w in set(e.words):
                self.by_word[w].append(e.joined)
        n = len(forms)
        self.idf = {w: math.log(1 + n / len(es)) for w, es in self.by_word.items()}
        self.most = math.log(1 + n)
        self.words = SegmentIndex(self.by_word, edits)
        self.wholes = SegmentIndex(forms, edits)
        self.starts: dict[str, set[str]] = defaultdict(set)
        self.whole_starts: dict[str, list[str]] = defaultdict(list)
        self.by_initial: dict[str, list[str]] = defaultdict(list)
        self.initials: dict[str, list[str]] = defaultdict(list)
        for w in self.by_word:
            self.by_initial[w[0]].append(w)
            for i in range(3, len(w)):
                self.starts[w[:i]].add(w)
        for e in forms.values():
            for i in range(3, len(e.joined)):
                self.whole_starts[e.joined[:i]].append(e.joined)
            if len(e.words) > 2:
                self.initials["".join(w[0] for w in e.words)].append(e.joined)

    def repair(self, token: str) -> list[tuple[str, float]]:
        """The vocabulary words that a typed token can stand for, with likeness."""
        if token in self.by_word:
            return [(token, 1.0)]
        found = {w: 1 - 0.6 * d / max(len(w), len(token)) for w, d in self.words.search(token).items()}
        if token in SHORT_FORMS and SHORT_FORMS[token] in self.by_word:
            found.setdefault(SHORT_FORMS[token], 0.97)
        if len(token) >= 3:
            for w in self.starts.get(token, ()):
                found[w] = max(found.get(w, 0), 0.9)
        elif token.isalpha():
            for w in self.by_initial.get(token[0], ()):
                if w.startswith(token) and len(w) > len(token):
                    found[w] = max(found.get(w, 0), 0.82)
        if len(token) >= 3 and not VOWEL.search(token, 1):
            for w in self.by_initial.get(token[0], ()):
                if len(w) > len(token) and w[-1] == token[-1] and _within(token, w):
                    found[w] = max(found.get(w, 0), 0.92)
        return list(found.items())

    def repair_whole(self, joined: str, short: bool, caps: bool) -> list[tuple[str, float]]:
        """The entries that a value without separators can stand for.

        ``short``: it ends like a shortened one; ``caps``: it is written like initials.
        """
        if joined in self.forms:
            return [(joined, 1.0)]
        found = {e: 1 - 0.6 * d / max(len(e), len(joined)) for e, d in self.wholes.search(joined).items()}
        if len(joined) >= (2 if short else 3):
            for e in self.whole_starts.get(joined, ()):
                found[e] = max(found.get(e, 0), 0.93 if short else 0.91)
        if len(joined) > 2:
            for e in self.initials.get(joined, ()):
                found[e] = max(found.get(e, 0), 0.95 if caps else 0.85)
        return list(found.items())

    def by_tokens(self, words: list[tuple[str, list[tuple[str, float]]]]) -> dict[str, float]:
        """Entries by soft TF-IDF of the repaired tokens."""
        scores: dict[str, float] = {}
        near = dict.fromkeys(e for _, repaired in words for w, _ in repaired for e in self.by_word[w])
        # the surest repairs take their words first
        words = sorted(words, key=lambda x: (x[0] in NOISE, -max((s for _, s in x[1]), default=0)))
        for joined in near:
            left = {w: self.idf[w] for w in self.forms[joined].words}
            own = sum(x * x for x in left.values())
            dot = query = 0.0
            for token, repaired in words:
                s, w = max(((s, w) for w, s in repaired if w in left), default=(0, ""))
                if s:
                    weight = left.pop(w)
                    dot += weight * weight * s
                    query += weight * weight
                elif token in NOISE or VERSION.fullmatch(token):
                    query += NOISE_WEIGHT
                else:
                    query += max(self.idf.get(token, self.most), 1) ** 2
            if dot:
                scores[joined] = dot / math.sqrt(query * own)
        return scores

    def rank(self, words, joined: str, short: bool, caps: bool) -> list[tuple[float, str]]:
        """The entries a value can stand for, best first; the whole is looked at where its tokens explain it badly."""
        if joined in self.forms:
            return [(1.0, joined)]
        if says_nothing([w for w, _ in words]):
            return []
        scores = self.by_tokens(words)
        if max(scores.values(), default=0) < SURE:
            for e, s in self.repair_whole(joined, short, caps):
                scores[e] = max(scores.get(e, 0), s)
        return sorted(((s, e) for e, s in scores.items()), reverse=True)

    def candidates(self, ranked: list[tuple[float, str]]) -> list[tuple[int, float]]:
        """(item, score) of all entries that may decide a row: a fitting country could lift them to the best or a tie with it."""
        best: dict[int, float] = {}
        # the best of a row is at least this; the last term is for rounding
        least = max([THRESHOLD, *(s for s, _ in ranked)]) - COUNTRY_BONUS - TIE - 1e-9
        for s, e in ranked:
            if s >= least:
                for item in self.forms[e].items:
                    best[item] = max(best.get(item, 0), s)
        return list(best.items())


def says_nothing(words: list[str]) -> bool:
    return not words or " ".join(words) in NOTHING_PHRASES or all(w in NOTHING or w.isdigit() for w in words)


def part_country(value: str, countries: Matcher | None) -> tuple[str, int | None]:
    """A city value without the country it also names, and that country's item."""
    if countries is None:
        return value, None
    for cut in COUNTRY_CUT.finditer(value):
        for rest, part in ((value[: cut.start()], value[cut.end() :]), (value[cut.end() :], value[: cut.start()])):
            words = tokens(part)
            if words and tokens(rest):
                found = countries.candidates(countries.rank([(w, countries.repair(w)) for w in words], "".join(words), False, False))
                if found and max(s for _, s in found) >= 0.86 and len("".join(words)) > 2:
                    return rest, max(found, key=lambda x: x[1])[0]
    return value, None


def _matchers(reference: list[tuple[str, int, str, list[str]]]) -> dict[str, Matcher]:
    by_kind: dict[str, list] = defaultdict(list)
    for kind, ref_id, name, aliases in reference:
        by_kind[kind].append((ref_id, name, aliases))
    return {k: Matcher(v) for k, v in by_kind.items()}


def read_reference(ref_item: DataFrame) -> list[tuple[str, int, str, list[str], str | None]]:
    if (n := ref_item.count()) > MAX_ENTRIES:
        raise ValueError(f"a reference list of {n} items is too large to send to every worker")
    return [(r["kind"], r["ref_id"], r["canonical"], r["aliases"] or [], r["country"]) for r in ref_item.where("kind is not null and canonical is not null").select("kind", "ref_id", "canonical", "aliases", "country").collect()]


def _clean(c: Column) -> Column:
    """Whether a value is more than blanks of any kind."""
    return c.isNotNull() & c.rlike(r"[^\s\u00a0\u2000-\u200f\u202f\u2060\u3000\ufeff]")


def map_values(values: DataFrame, ref_item: DataFrame) -> DataFrame:
    """``kind, value, items`` for the distinct ``kind, value`` rows of ``values``.

    ``items`` are the candidates as (ref_id, score, country), empty where no item of the kind is meant;
    ``named_country`` is the item of a country that a city value names besides.
    """
    spark = values.sparkSession
    reference = read_reference(ref_item)
    countries = {ref_id: (name if kind == "country" else country) for kind, ref_id, name, _, country in reference}
    shared = spark.sparkContext.broadcast([r[:4] for r in reference])
    made: dict = {}

    def matcher(kind: str) -> Matcher | None:
        if not made:
            made.update(_matchers(shared.value))
        return made.get(kind)

    def cut(batches):
        # several typed values fold into the same words
        for pdf in batches:
            rows = []
            for kind, value in zip(pdf["kind"], pdf["value"]):
                rest, country = part_country(value, matcher("country")) if kind == "city" else (value, None)
                words = tokens(rest)
                rows.append((kind, value, words, "".join(words), rest.rstrip().endswith(("…", ".")), caps_of(rest), country))
            yield pd.DataFrame(rows, columns=["kind", "value", "words", "joined", "short", "caps", "country"]).astype({"country": "Int64"})

    folded = durable(values.mapInPandas(cut, "kind string, value string, words array<string>, joined string, short boolean, caps boolean, country long"))

    def repair(batches):
        for pdf in batches:
            pdf["repaired"] = [" ".join(f"{w}={s:.5f}" for w, s in m.repair(t)) if (m := matcher(k)) else "" for k, t in zip(pdf["kind"], pdf["token"])]
            yield pdf

    # few bytes but much work a row: as many partitions as the cluster runs tasks, whatever the bytes
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = folded.select("kind", F.explode("words").alias("token")).distinct().repartition(spread)
    repaired = words.mapInPandas(repair, "kind string, token string, repaired string").where("repaired <> ''")
    repaired = durable(repaired.select(F.concat_ws(" ", "kind", "token").alias("key"), "repaired"))
    texts = folded.groupBy("kind", "words", "joined", "short", "caps").agg(F.lit(1).alias("one")).drop("one")
    texts = durable(texts.withColumn("text_id", F.monotonically_increasing_id()))
    parts = texts.select("text_id", F.explode("words").alias("token"), F.col("kind")).select("text_id", "token", F.concat_ws(" ", "kind", "token").alias("key"))
    found = lookup(durable(parts), repaired, "key", "inner").groupBy("text_id").agg(F.concat_ws("\n", F.collect_list(F.concat_ws(" ", "token", "repaired"))).alias("found"))

    def rank(batches):
        for pdf in batches:
            out = []
            for kind, words, joined, short, caps, found in zip(pdf["kind"], pdf["words"], pdf["joined"], pdf["short"], pdf["caps"], pdf["found"]):
                m = matcher(kind)
                known = {}
                for line in found.split("\n") if found else ():
                    token, *pairs = line.split(" ")
                    known[token] = [(w, float(s)) for w, _, s in (p.partition("=") for p in pairs)]
                ranked = m.rank([(w, known.get(w, [])) for w in words], joined, bool(short), bool(caps)) if m else []
                out.append(m.candidates(ranked) if m else [])
            yield pd.DataFrame({"kind": pdf["kind"], "words": pdf["words"], "joined": pdf["joined"], "short": pdf["short"], "caps": pdf["caps"], "items": [[(i, s, countries.get(i)) for i, s in o] for o in out]})

    ranked = texts.join(found, "text_id", "left").repartition(spread).select("kind", "words", "joined", "short", "caps", "found").mapInPandas(rank, "kind string, words array<string>, joined string, short boolean, caps boolean, items array<struct<ref_id:long,score:double,country:string>>")
    return folded.join(ranked, ["kind", "words", "joined", "short", "caps"]).select("kind", "value", "items", F.col("country").alias("named_country"))


def pick(items: Column, country: Column) -> Column:
    """The item meant: the best candidate above the threshold, where its country fits a little more; 0 for none or a tie."""
    lifted = F.transform(items, lambda i: F.struct(i["ref_id"].alias("ref_id"), (i["score"] + F.when(i["country"] == country, F.lit(COUNTRY_BONUS)).otherwise(0.0)).alias("score")))
    best = F.array_max(F.transform(lifted, lambda i: i["score"]))
    top = F.filter(lifted, lambda i: i["score"] > best - TIE)
    return F.when((best >= THRESHOLD) & (F.size(top) == 1), F.get(top, F.lit(0))["ref_id"]).otherwise(F.lit(0).cast("long"))


def _mapped(rows: DataFrame, mapped: DataFrame, kind: str, value: str) -> DataFrame:
    dim = mapped.where(F.col("kind") == kind).select(F.col("value").alias(value), "items", "named_country")
    return lookup(rows, dim, value)


def resolve(mentions: DataFrame, locations: DataFrame, ref_item: DataFrame) -> DataFrame:
    """``field, row_id, ref_id`` of every typed value that isn't just the canonical name of one item of its kind.

    ``mentions`` have ``mention_id, label, name``, ``locations`` ``location_id, city, country``. Null and blank values
    and labels other than Industry and Technology are no cases; ``ref_id`` is 0 where no item of the list is meant.
    Repeated deliveries come out once.
    """
    one = ref_item.groupBy("kind", "canonical").agg(F.count("*").alias("n")).where("n = 1")
    exact = F.broadcast(one.select(F.col("kind").alias("kind"), F.col("canonical").alias("value"), F.lit(True).alias("exact")))
    names = mentions.where(F.col("label").isin("Industry", "Technology") & _clean(F.col("name")) & F.col("mention_id").isNotNull()).select(F.lower("label").alias("kind"), F.col("name").alias("value"), F.col("mention_id").alias("row_id"))
    names = durable(names.join(exact.drop("exact"), ["kind", "value"], "left_anti").distinct())
    places = durable(locations.where("location_id is not null").select(F.col("location_id").alias("row_id"), "city", "country").where(_clean(F.col("city")) | _clean(F.col("country"))).distinct())
    wanted = names.select("kind", "value").distinct()
    for kind in ("city", "country"):
        wanted = wanted.unionByName(places.where(_clean(F.col(kind))).select(F.lit(kind).alias("kind"), F.col(kind).alias("value")).distinct())
    mapped = durable(map_values(wanted, ref_item))

    key = F.concat_ws(" ", "kind", "value").alias("key")
    labelled = lookup(durable(names.select("kind", "row_id", key)), mapped.where(F.col("kind").isin("industry", "technology")).select(key, "items"), "key")
    found = labelled.select(F.col("kind").alias("field"), "row_id", pick(F.col("items"), F.lit(None).cast("string")).alias("ref_id"))

    countries = F.broadcast(ref_item.where("kind = 'country'").select(F.col("ref_id").alias("c_id"), F.col("canonical").alias("c_name")))
    rows = durable(_mapped(places, mapped, "country", "country").select("row_id", "city", "country", pick(F.col("items"), F.lit(None).cast("string")).alias("country_id")))
    rows = _mapped(rows, mapped, "city", "city").join(countries, F.col("c_id") == F.coalesce("named_country", "country_id"), "left")
    rows = durable(rows.select("row_id", "city", "country", "country_id", pick(F.col("items"), F.col("c_name")).alias("city_id")))
    for kind in ("city", "country"):
        cases = rows.where(_clean(F.col(kind))).select(F.lit(kind).alias("kind"), F.col(kind).alias("value"), "row_id", F.coalesce(f"{kind}_id", F.lit(0)).alias("ref_id"))
        cases = cases.join(exact.drop("exact"), ["kind", "value"], "left_anti").select(F.col("kind").alias("field"), "row_id", "ref_id")
        found = found.unionByName(cases)
    return found.distinct()
