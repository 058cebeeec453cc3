"""Linking the spellings of one person or organisation (problem 2).

Method: a pigeonhole segment join. With at most k edits between two names, one of k+1 segments of the first stands unchanged
in the second, moved by k places at most; so segments go into an inverted index, moved substrings look them up, and a
banded edit distance verifies. The join runs over the distinctive part of a name (surname, an organisation's own word), in blocks of
what the rest of the name allows. All links come from it: names whose parts are equal are pairs at distance 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, pairs_within

# Words that carry nothing in the name of an organisation, those that no person has, and particles of surnames.
SMALL_WORDS = {"the", "for", "f", "of", "and", "de", "der", "des", "fur"}
LINKING_WORDS = {"for", "f", "of", "fur"}
PARTICLES = {"van", "von", "de", "der", "den", "del", "della", "di", "da", "das", "do", "dos", "du", "la", "le", "los", "las", "al", "el", "bin", "ibn", "ben", "ter", "ten", "zu", "zur", "zum", "y", "e"}


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def within(a: str, b: str, k: int) -> bool:
    """Whether a becomes b by at most k insertions, deletions, replacements and swaps of neighbours; only a band of 2k+1 is computed."""
    if abs(len(a) - len(b)) > k:
        return False
    far = k + 1
    before: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), k) + 1)}
    for i in range(1, len(a) + 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            if j == 0:
                new[0] = i
                continue
            d = min(row.get(j, far) + 1, new.get(j - 1, far) + 1, row.get(j - 1, far) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before.get(j - 2, far) + 1)
            new[j] = d
        if min(new.values()) > k:
            return False
        before, row = row, new
    return row.get(len(b), far) <= k


def segment_join(left: DataFrame, right: DataFrame, k: int = 1, same: bool = False) -> DataFrame:
    """(block, a, b): the distinct pairs of a name of left and one of right, equal in block, at most k edits apart; equal names only if same.

    Both tables are (block STRING, name STRING); nulls join nothing. A swap of neighbours counts as one edit. It touches two segments only where it
    crosses their border, so the index also holds each name with every choice of borders swapped: with s such swaps undone the k - s
    edits left spare one of k+1 segments, so no pair is lost for any k. Names of k letters or fewer have empty segments and are compared
    within the index entries of their lengths.
    """
    size = F.length("name")
    start = lambda n, i: F.floor(n * i / (k + 1)).cast("int")  # noqa: E731  where segment i of a name of n letters begins
    left, right = (t.select("block", "name").where("block is not null and name is not null").distinct() for t in (left, right))
    index = right.withColumn("n", size).withColumn("v", F.col("name"))
    for i in range(1, k + 1):  # c letters stand before border i; c = n and c = 0 are no borders
        c = start(F.col("n"), F.lit(i))
        turned = F.concat(F.substring("v", F.lit(1), c - 1), F.substring("v", c + 1, F.lit(1)), F.substring("v", c, F.lit(1)), F.substring("v", c + 2, F.col("n")))
        index = index.withColumn("v", F.explode(F.when((c > 0) & (c < F.col("n")), F.array_distinct(F.array(F.col("v"), turned))).otherwise(F.array("v"))))
    index = index.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(k + 1)])))
    index = index.withColumn("seg", F.substring("v", start(F.col("n"), F.col("i")) + 1, start(F.col("n"), F.col("i") + 1) - start(F.col("n"), F.col("i"))))
    index = index.select("block", "n", "i", "seg", F.col("name").alias("b")).distinct()
    probe = left.withColumn("n", F.explode(F.sequence(F.greatest(size - k, F.lit(1)), size + k))).withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(k + 1)])))
    probe = probe.withColumn("at", start(F.col("n"), F.col("i"))).withColumn("len", start(F.col("n"), F.col("i") + 1) - F.col("at"))
    probe = probe.withColumn("p", F.explode(F.sequence(F.greatest(F.col("at") - k, F.lit(0)), F.col("at") + k))).where(F.col("p") + F.col("len") <= size)
    probe = probe.withColumn("seg", F.substring("name", F.col("p") + 1, F.col("len"))).select("block", "n", "i", "seg", F.col("name").alias("a")).distinct()
    near = probe.join(index, ["block", "n", "i", "seg"]).select("block", "a", "b")
    near = near.where((F.lit(same) | (F.col("a") != F.col("b"))) & (F.levenshtein("a", "b", 2 * k) >= 0)).distinct()
    if not k:
        return near

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x == y or within(x, y, k) for x, y in zip(a, b, strict=True)], dtype=bool)

    return near.where(close("a", "b"))


def spellings(hits: DataFrame, column: str = "authors") -> DataFrame:
    """(spelling STRING, n LONG): the distinct names in lists of names, with their uses.

    A list is cut at semicolons if it has any, else at commas, ` and ` and ` & ` (also after a comma). A name is trimmed and its inner
    white space made one blank. Null and empty lists, empty names and `et al.` give nothing.
    """
    text = F.regexp_replace(column, r"[\s ]+", " ")
    cut = F.when(text.contains(";"), F.split(text, ";")).otherwise(F.split(text, r",(?: ?(?:and|&) )?| and | & "))
    rows = hits.select(F.explode(F.transform(cut, lambda x: F.trim(x))).alias("spelling"))
    return rows.where("spelling != '' and not lower(spelling) rlike '^(and |& )?et al[.]?$'").groupBy("spelling").agg(F.count("*").alias("n"))


def words_of(spelling: str) -> list[tuple[str, str]]:
    """The words of a spelling as they stand and folded; points end words."""
    words = [w for w in re.split(r"[\s,]+", re.sub(r"\.(?=\w)", ". ", spelling)) if w.strip(".")]
    return [(w, fold(w.strip(".'’`"))) for w in words]


def organisation(bare: list[str]) -> tuple[str, str, str, str, str]:
    """(org, core, rest, initial, middle): core the first and the last word, rest the first letters of all words, middle the words between."""
    own = [b for b in bare if b not in SMALL_WORDS] or bare
    return "org", f"{own[0]} {own[-1]}", " ".join(sorted(b[:3] for b in own)), "", " ".join(own[1:-1])


def parse(spelling: str, org: bool = False) -> tuple[str, str, str, str, str]:
    """(kind, core, rest, initial, middle) of one spelling.

    kind is full, short (a cut given name), initial, none (one word), or org (if told so, or by a linking word such as `of`). core is the surname without
    its particles, or the organisation's own two candidate words joined by a blank; rest the given name or the first letters of an
    organisation's words, middle the first letter of further given names.
    """
    head, comma, tail = spelling.partition(",")
    words = words_of(spelling)
    if not words:
        return "none", fold(spelling), "", "", ""
    bare = [b for _, b in words]
    if org or len([b for b in bare if len(b) > 2]) >= 2 and (any(b in LINKING_WORDS and (len(b) > 1 or w.islower()) for w, b in words[1:]) or words[0][0].lower() == "the"):
        return organisation(bare)
    initials = [len(b) == 1 or (len(b) <= 2 and w.isupper()) for w, b in words]
    small = [b in PARTICLES and not w[:1].isupper() for w, b in words]
    if len(words) == 1 or all(small):
        return "none", bare[0], "", "", ""
    if comma and head.strip() and tail.strip():
        k = len(words_of(head))
        surname, given = list(range(k)), list(range(k, len(words)))
    else:
        upper = [w.strip(".").isupper() and len(b) > 2 for w, b in words]
        if any(upper) and not all(u or i for u, i in zip(upper, initials, strict=True)):
            surname = [i for i, u in enumerate(upper) if u]
        elif initials[-1] and not initials[0]:
            surname = [i for i, x in enumerate(initials) if not x and not small[i]][:1] or [0]
        else:
            surname = [len(words) - 1]
        given = [i for i in range(len(words)) if i not in surname]
    core = " ".join(bare[i] for i in surname if not small[i]) or bare[surname[-1]]
    given = [i for i in given if not small[i]]
    if not given:
        return "none", core, "", "", ""
    letters = "".join(bare[i][0] for i in given if bare[i])
    first = given[0]
    if initials[first]:
        return "initial", core, "", letters[:1], letters[1:2]
    kind = "short" if words[first][0].endswith(".") and any(len(b) > 2 for b in bare) else "full"
    return kind, core, bare[first], bare[first][:1], letters[1:2]


def with_kinds(names: DataFrame, given: DataFrame) -> DataFrame:
    """names (spelling, n) with kind, core, rest, initial and middle. given is (word): known given names.

    Whether three words or more name a person or an organisation is decided by the other spellings: an organisation shares its last word and one more with other
    long spellings, whose first words differ, and neither its first nor its last word is a given name (known, or first of a spelling of two words). A word that
    begins another long spelling with the same last word doesn't count as shared: two given names of one person stand in either order.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for x in b.spelling:
                words = [w for w in words_of(x) if w[1] not in PARTICLES]
                long = [w for _, w in words if len(w) > 2 and w not in SMALL_WORDS]
                rows.append((long if len(long) >= 3 and "," not in x else [], words[0][1] if len(words) == 2 else None))
            yield pd.concat([b.reset_index(drop=True), pd.DataFrame(rows, columns=["long", "begins"])], axis=1)

    rows = materialize(names.select("spelling", "n").mapInPandas(cut, "spelling string, n long, long array<string>, begins string"), "cut")
    first = rows.where("length(begins) > 1").select(F.col("begins").alias("word")).unionByName(given.select("word")).distinct().withColumn("given", F.lit(True))
    each = rows.where("size(long) > 0").select("spelling", F.element_at("long", 1).alias("first"), F.element_at("long", -1).alias("ends"), F.posexplode("long").alias("at", "word"), F.size("long").alias("size"))
    swapped = each.where("at = 0").select("word", "ends").distinct().withColumn("swapped", F.lit(True))
    shared = each.groupBy("word").agg(F.count_distinct("first").alias("firsts")).where("firsts > 1")
    edge = (F.col("at") == 0) | (F.col("at") == F.col("size") - 1)
    told = each.join(shared, "word", "left").join(first, "word", "left").join(swapped, ["word", "ends"], "left").groupBy("spelling").agg(
        F.count_if(F.col("firsts").isNotNull() & (F.col("at") > 0) & F.col("swapped").isNull()).alias("shared"), F.max(F.col("firsts").isNotNull() & (F.col("at") == F.col("size") - 1)).alias("last"), F.coalesce(F.max(F.col("given") & edge), F.lit(False)).alias("person")
    )
    told = told.where("shared > 1 and last and not person").select("spelling", F.lit(True).alias("org"))

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [parse(x, bool(o)) for x, o in zip(b.spelling, b.org, strict=True)]
            yield pd.concat([b[["spelling", "n"]].reset_index(drop=True), pd.DataFrame(out, columns=["kind", "core", "rest", "initial", "middle"], dtype=str)], axis=1)

    both = rows.select("spelling", "n").join(told, "spelling", "left").fillna(False, ["org"])
    return both.mapInPandas(parsed, "spelling string, n long, kind string, core string, rest string, initial string, middle string")


def link_spellings(hits: DataFrame, nicknames: DataFrame, column: str = "authors", k: int = 1) -> DataFrame:
    """(spelling STRING, entity STRING): the spellings of lists of names, and of each its entity, named after a main spelling.

    nicknames is (formal STRING, short_form STRING), in any case, possibly incomplete: further short forms are learned from given
    names that stand with the same surnames. Every spelling has one row; one that links to nothing is its own entity. An empty
    table gives no rows; null lists count as empty; other columns of hits are ignored.
    """
    # Given names: what each written form can stand for.
    table = nicknames.select(F.lower(F.trim("formal")).alias("formal"), F.lower(F.trim("short_form")).alias("rest")).where("formal is not null and rest is not null").distinct()
    names = materialize(with_kinds(spellings(hits, column), table.select(F.col("formal").alias("word")).union(table.select("rest"))), "spellings")
    # The organisation's own word stands first or last, and never inside another organisation's name, where words of kind and field do.
    org = names.where("kind = 'org'")
    inside = org.select(F.explode(F.split("middle", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("inner"))
    org = org.withColumn("w", F.explode(F.array_distinct(F.split("core", " "))))
    outside = org.groupBy("w").agg(F.count("*").alias("outer"))
    rare = Window.partitionBy("spelling").orderBy(F.coalesce("inner", F.lit(0)), "outer", F.desc(F.length("w")), "w")
    org = org.join(outside, "w").join(inside, "w", "left").withColumn("r", F.row_number().over(rare)).where("r = 1")
    org = org.withColumn("rest", F.array_join(F.array_except(F.split("rest", " "), F.array(F.substring("w", 1, 3))), " "))
    org = org.select("spelling", "n", "kind", F.col("w").alias("core"), "rest", F.col("rest").alias("initial"), F.lit("").alias("middle"))
    names = materialize(names.where("kind != 'org'").unionByName(org), "spellings")
    person = names.where("kind in ('full', 'short', 'initial')")

    used = person.where("kind = 'full'").groupBy("rest").agg(F.count_distinct("core").alias("cores"), F.count_if(F.col("middle") != "").alias("with_middle"))
    used = materialize(used, "used")  # each step is a table: one plan over all of them holds hundreds of operators, and the driver's memory with them
    formal = used.where("with_middle > 0").select(F.col("rest").alias("formal")).union(table.select("formal")).distinct()
    formal = formal.join(used.select(F.col("rest").alias("formal"), "cores"), "formal", "left").fillna(1, ["cores"])
    formal = materialize(formal, "formal")
    typed = used.select("rest", "cores").join(formal.select(F.col("formal").alias("rest")), "rest", "left_anti")
    one = F.lit("")
    misspelt = segment_join(typed.select(one.alias("block"), F.col("rest").alias("name")), formal.where("length(formal) > 3").select(one.alias("block"), F.col("formal").alias("name")), k)
    misspelt = materialize(misspelt.select(F.col("a").alias("rest"), F.col("b").alias("formal")), "misspelt")
    unknown = typed.join(table.select("rest").distinct(), "rest", "left_anti")
    with_formal = person.where("kind = 'full'").join(formal.select(F.col("formal").alias("rest")), "rest", "left_semi").select("core", F.col("rest").alias("formal")).distinct()
    together = person.where("kind = 'full'").join(unknown, "rest").select("core", "rest", "cores").distinct().join(with_formal, "core").groupBy("rest", "cores", "formal").agg(F.count("*").alias("both"))
    alike = (F.substring("rest", 1, 2) == F.substring("formal", 1, 2)) | F.expr("formal like concat('%', substring(rest, 1, 3), '%')")
    best = Window.partitionBy("rest").orderBy(F.desc(F.col("both") + F.when(alike, 0.5).otherwise(0)), "formal")
    learned = together.where(((F.col("both") >= 2) | alike) & (F.col("both") >= 0.3 * F.col("cores"))).withColumn("r", F.row_number().over(best)).where("r = 1").select("rest", "formal")
    means = formal.select(F.col("formal").alias("rest"), "formal").unionByName(table.select("rest", "formal")).unionByName(misspelt).unionByName(learned).distinct()
    means = materialize(means, "given")

    # Anchors: a surname with a formal given name (one more for each middle initial if they differ), or an organisation.
    full = person.where("kind = 'full'").join(formal.select(F.col("formal").alias("rest")), "rest", "left_semi")
    people = full.groupBy("core", "rest").agg(F.sum("n").alias("n"), F.count("*").alias("forms"), F.sort_array(F.collect_set(F.nullif("middle", F.lit("")))).alias("middles"))
    people = people.withColumn("middle", F.explode(F.when(F.size("middles") > 0, F.col("middles")).otherwise(F.array(F.lit(""))))).select("core", "rest", "middle", "n", "forms")
    groups = names.where("kind = 'org'").groupBy("core", "rest").agg(F.sum("n").alias("n"), F.count("*").alias("forms")).select("core", "rest", F.lit("").alias("middle"), "n", "forms")
    anchor = people.withColumn("sort", F.lit("p")).unionByName(groups.withColumn("sort", F.lit("o"))).withColumn("anchor", F.concat_ws("|", "sort", "core", "rest", "middle"))
    anchor = materialize(anchor, "anchors")

    # Near surnames with the same rest: the one with fewer forms is a misspelling of the other.
    at = lambda t: t.select(F.concat_ws("|", "sort", "rest").alias("block"), F.col("core").alias("name"))
    near = materialize(segment_join(at(anchor), at(anchor), k), "near")
    side = lambda s: anchor.select(F.concat_ws("|", "sort", "rest").alias("block"), F.col("core").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("anchor", "n", "forms", "middle")])
    near = near.join(side("a"), ["block", "a"]).join(side("b"), ["block", "b"])
    agree = (F.col("middle_a") == "") | (F.col("middle_b") == "") | (F.col("middle_a") == F.col("middle_b"))
    lower = (F.struct("forms_a", "n_a", "anchor_a") < F.struct("forms_b", "n_b", "anchor_b")) & (F.col("forms_a") <= F.greatest(F.lit(2), F.col("forms_b") / 2))
    better = Window.partitionBy("anchor_a").orderBy(F.desc("forms_b"), F.desc("n_b"), "anchor_b")
    moved = near.where(agree & lower).withColumn("r", F.row_number().over(better)).where("r = 1").select(F.col("anchor_a").alias("anchor"), F.col("anchor_b").alias("to"))
    moved = materialize(moved, "moved")

    # Every spelling against the anchors in its block: people by the first letter of what the given name can stand for, organisations by their other words.
    # Surnames of two words are asked by each of them too.
    asks = person.where("kind != 'short'").join(means, "rest", "left").withColumn("formal", F.coalesce("formal", F.when(F.col("kind") == "full", F.col("rest"))))
    asks = asks.unionByName(person.where("kind = 'short'").withColumn("formal", F.lit(None).cast("string")))
    asks = asks.withColumn("block", F.concat(F.lit("p|"), F.coalesce(F.substring("formal", 1, 1), F.col("initial"))))
    asks = asks.unionByName(names.where("kind = 'org'").withColumn("formal", F.lit(None).cast("string")).withColumn("block", F.concat(F.lit("o|"), "rest")))
    asks = asks.withColumn("part", F.explode(F.when(F.col("core").contains(" "), F.array_distinct(F.concat(F.array("core"), F.split("core", " ")))).otherwise(F.array("core"))))
    asks = materialize(asks.select("spelling", "kind", "core", "part", "rest", "initial", "middle", "formal", "block"), "asks")
    to = anchor.withColumn("block", F.when(F.col("sort") == "p", F.concat(F.lit("p|"), F.substring("rest", 1, 1))).otherwise(F.concat(F.lit("o|"), "rest")))
    to = to.select("block", F.col("core").alias("to_core"), F.col("rest").alias("to_rest"), F.col("middle").alias("to_middle"), "n", "anchor")
    pairs = segment_join(asks.select("block", F.col("part").alias("name")), to.select("block", F.col("to_core").alias("name")), k, same=True)
    pairs = materialize(pairs, "pairs")
    offered = asks.join(pairs.select("block", F.col("a").alias("part"), F.col("b").alias("to_core")), ["block", "part"]).join(to, ["block", "to_core"])
    fits = (F.col("formal") == F.col("to_rest")) | ((F.col("kind") == "short") & F.col("to_rest").startswith(F.col("rest"))) | (F.col("kind") == "initial") | (F.col("kind") == "org")
    fits &= (F.col("middle") == "") | (F.col("to_middle") == "") | (F.col("middle") == F.col("to_middle")) | (F.col("kind") == "org")
    # Equal surnames come first; of an organisation only the equal own word, since near ones are moved as anchors below.
    near_core = F.when(F.col("core") == F.col("to_core"), 2).when(F.col("part") == F.col("to_core"), 1).otherwise(0)
    # a formal name in full only stands for itself; a short form that is a formal name elsewhere can stand for both
    choice = Window.partitionBy("spelling").orderBy(F.desc(near_core), F.desc((F.col("rest") == F.col("to_rest")).cast("int")), F.desc((F.col("middle") == F.col("to_middle")).cast("int")), F.desc("n"), "anchor")
    linked = offered.where(fits & ((F.col("kind") != "org") | (F.col("part") == F.col("to_core")))).withColumn("r", F.row_number().over(choice)).where("r = 1").select("spelling", "anchor")
    linked = materialize(linked, "chosen")
    for _ in range(2):  # a misspelling of a misspelling moves on once more
        linked = linked.join(moved, "anchor", "left").select("spelling", F.coalesce("to", "anchor").alias("anchor"))
    linked = materialize(linked, "linked")
    # What has no anchor links to spellings with the same surname and first letter of what the given name stands for: the join again, with no edits.
    stands = means.groupBy("rest").agg(F.min("formal").alias("formal"))
    first = F.coalesce(F.substring("formal", 1, 1), F.nullif("initial", F.lit("")), F.col("spelling"))
    free = materialize(names.join(linked, "spelling", "left_anti").join(stands, "rest", "left").select("spelling", "core", first.alias("block")), "free")
    # A surname of two words goes to spellings that have one of them alone, the last before the first.
    asked = free.withColumn("part", F.explode(F.when(F.col("core").contains(" "), F.array_distinct(F.concat(F.reverse(F.split("core", " ")), F.array("core")))).otherwise(F.array("core"))))
    met = segment_join(asked.select("block", F.col("part").alias("name")), free.select("block", F.col("core").alias("name")), 0, same=True)
    met = materialize(asked.join(met.select("block", F.col("a").alias("part")), ["block", "part"]), "met")
    place = F.array_position(F.reverse(F.split("core", " ")), F.col("part"))
    met = met.groupBy("spelling", "block").agg(F.min_by("part", F.when(place > 0, place).otherwise(99)).alias("part"))
    return linked.unionByName(met.select("spelling", F.concat_ws("|", F.lit("f"), "part", "block").alias("anchor"))).select("spelling", F.col("anchor").alias("entity"))


def spelling_pairs(entities: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of different spellings of an entity, the smaller first."""
    return pairs_within(entities, "entity", "spelling", "name_a", "name_b")
