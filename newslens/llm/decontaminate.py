"""Benchmark decontamination: windows of canonical templates, in DataFrame functions only.

A text is read as words, numbers, unit signs and sentence ends. Canonicalisation lower-cases words and replaces what a
re-parameterised question changes by typed placeholders: numbers by <num>, unit signs and unit words after a number by
<unit>, names - runs of capitalised words, however many words they have - by one <name>. A capitalised word that opens a
sentence may be a name or not, so texts are read both ways: as a word, and, in the windows that hold such a word, as the
start of a name. Every window of WINDOW canonical tokens is hashed; the documents' windows are hash-joined with those of
the benchmark items. (A shorter item is one window of its own length.) Item windows with fewer than LITERALS ordinary words
prove nothing by their placeholders; where an item has such windows, windows of its plain lower-case tokens take their
place, so that word-for-word copies of every item are found.

Few texts hold anything of a benchmark, so most are put aside before their windows are built. Two ordinary words that are
neighbours in an item's window are neighbours among the words of every text that holds the window: these pairs are looked for
in all texts by a hash join (words are cut by one regular expression and paired by a shifted copy): first the rarest pair of
each window alone (rare in a few texts, which decides nothing else), then, in texts that hold one of these, all pairs. A text is a candidate if it holds all pairs of as many
windows of an item as a hit needs. No hit is lost: it holds these windows whole. Windows without such a pair (of numbers, names or
single words between them) count as held, and are sought in all texts for items that they alone could report. Candidates are
staged, each text once, and everything below reads only them.

Positions are those of the tokens, whatever form a window has. Windows that match in a row lie on one diagonal (position in
the text minus position in the item); a word put in or left out moves the rest to another one. A candidate is a diagonal, or
a chain of diagonals of one document and item whose neighbours are at most half the item's length (or WINDOW) apart. It is a
hit if its distinct item windows are COVERAGE of the item's template windows, or of all its windows. Then the slots inside
matched windows are compared: where each value of the item stands for one value in the text throughout - "12 ... 12" may become
"7 ... 7", and two values of the item may become one - the copy is consistent; with "7 ... 9" it is reported as well, with
consistent = false. Words that open sentences are not held to that. A copy is verbatim if all tokens of the item stand in the text
in a row, letter for letter.

The benchmark side is broadcast while it has at most MOST_BROADCAST windows, and joined by a shuffle beyond that. Slots are
read only from documents with a hit. Documents and items are keyed by the MD5 of their text, and window rows hold keys and
hashes, never texts; ids are joined on at the end.

Cases: null and empty texts have no windows; texts are read whole; repeated windows of an item are joined once each;
repeated documents are flagged alike; rows that share an id, or have none, are judged each by its own text, and so are
items; items without words match nothing; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newslens.llm.common import stage
from newslens.operators.common import maybe_broadcast

WINDOW = 8
LITERALS = 4
COVERAGE = 0.5
MOST_BROADCAST = 500_000
#: Texts that tell common pairs from rare ones; that decides which pair is sought first, and nothing else.
SAMPLE = 8000
#: First words of sought pairs that a plan may list.
MOST_FIRST = 20_000

# --- fixed values: unit signs and words -----------------------------------------------------------------
SIGNS = "% $ € £ ¥ °".split()
UNITS = (
    "mm cm m km mg g kg t ml l kb mb gb tb s ms h min hz khz mhz ghz w kw v a j kj c f k ft in lb oz mph kmh usd eur gbp "
    "percent dollars dollar euros euro pounds pound cents cent meters meter metres metre kilometers kilometer kilometres "
    "kilometre miles mile feet foot inches inch grams gram kilograms kilogram liters liter litres litre seconds second "
    "minutes minute hours hour days day weeks week months month years year degrees degree").split()
ENDS = [".", "!", "?", ":", "\n"]
#: Before a capitalised word that opens a sentence, and for a name right after it; no token holds these signs.
OPENER = "^"
AFTER = "+"
# --- end fixed values -----------------------------------------------------------------------------------

# Possessive, and the commonest letters listed before the class of all: the same matches without trying again.
_TOKEN = r"[a-zA-Z\p{L}]++(?:['’-]\p{L}++)*+|\d++(?:[.,:/]\d++)*+|[%$€£¥°]|[.!?:\n]"


def tokens(text: Column) -> Column:
    """Words, numbers, unit signs and sentence ends of a text; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))


def _kinds(toks: str) -> Column:
    """The canonical form of every token of an array column. What has no place of its own is empty: sentence ends, and names
    after a name. A capitalised word that opens a sentence is in lower case after OPENER, and a name next to it is AFTER."""

    def capital(t):
        first, rest = F.substring(t, 1, 1), F.substring(t, 2, 1 << 30)
        return (first != F.lower(first)) & (rest != "") & (rest == F.lower(rest)) & ~t.isin(SIGNS)

    def canonical(t, i):
        before = F.when(i > 0, F.get(F.col(toks), i - 1))
        first = F.substring(t, 1, 1)
        after_number = F.substring(before, 1, 1).between("0", "9")
        unit = F.lower(t).isin(UNITS) & after_number
        opens = before.isNull() | before.isin(ENDS)
        # what stands before is a name, too, unless it is a unit
        second = F.when(i > 1, F.get(F.col(toks), i - 2))
        follows = capital(before) & ~(F.lower(before).isin(UNITS) & F.coalesce(F.substring(second, 1, 1).between("0", "9"), F.lit(False)))
        name = F.when(opens, F.concat(F.lit(OPENER), F.lower(t))).when(~follows, "<name>").when(second.isNull() | second.isin(ENDS), AFTER).otherwise("")
        # most tokens begin with a small letter: neither number, sign nor name
        return (F.when(first.between("a", "z"), F.when(unit, "<unit>").otherwise(F.lower(t)))
                .when(first.between("0", "9"), "<num>").when(t.isin(ENDS), "").when(t.isin(SIGNS) | unit, "<unit>")
                .when(capital(t), name).otherwise(F.lower(t)))

    return F.transform(toks, canonical)


def _from_one(n: Column) -> Column:
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _templates(rows: DataFrame, *keep: str) -> DataFrame:
    """rows (id, text) -> (id, canon_F, places_F) of the forms word (sentence openers are words) and name (they are names),
    and opens: where they stand in canon_name. Places count all tokens from 1. ``keep``: toks and kinds, to hold besides."""
    def kind(i):
        return F.get("kinds", i - 1)

    toks = rows.select("id", tokens(F.col("text")).alias("toks"))
    kinds = toks.select("id", "toks", _kinds("toks").alias("kinds"))
    word = kinds.select("*", F.filter(_from_one(F.size("kinds")), lambda i: kind(i) != "").alias("places_word"))
    name = word.select("*", F.filter("places_word", lambda i: kind(i) != AFTER).alias("places_name"))
    return name.select(
        "id", *keep, "places_word", "places_name",
        F.transform("places_word", lambda i: F.when(kind(i).startswith(OPENER), F.substring(kind(i), 2, 1 << 30)).when(kind(i) == AFTER, "<name>").otherwise(kind(i))).alias("canon_word"),
        F.transform("places_name", lambda i: F.when(kind(i).startswith(OPENER), "<name>").otherwise(kind(i))).alias("canon_name"),
        F.filter(_from_one(F.size("places_name")), lambda k: kind(F.get("places_name", k - 1)).startswith(OPENER)).alias("opens"))


def _literals(rows: DataFrame) -> DataFrame:
    """rows (id, text) -> (id, canon_plain, places_plain): all tokens in lower case, without sentence ends."""
    toks = rows.select("id", F.transform(tokens(F.col("text")), F.lower).alias("low"))
    placed = toks.select("id", "low", F.filter(_from_one(F.size("low")), lambda i: ~F.get("low", i - 1).isin(ENDS)).alias("places_plain"))
    return placed.select("id", F.transform("places_plain", lambda i: F.get("low", i - 1)).alias("canon_plain"), "places_plain")


def _starts(form: str, n: int) -> Column:
    """Where windows of n tokens begin; those of the form name only where one holds a sentence opener."""
    last = F.size(f"canon_{form}") - n + 1
    if form != "name":
        return _from_one(last)
    near = F.transform("opens", lambda p: F.when((F.greatest(p - n + 1, F.lit(1)) <= F.least(p, last)), F.sequence(F.greatest(p - n + 1, F.lit(1)), F.least(p, last))).otherwise(F.array().cast("array<int>")))
    return F.array_distinct(F.flatten(near))


def _windows(templates: DataFrame, forms: list[str], lengths: list[int]) -> DataFrame:
    """(id, at, form, size, h): the hash of every window of each form and length, and the place of its first token."""

    def hashes(form: str, n: int) -> Column:
        return F.transform(f"starts_{form}_{n}", lambda i: F.struct(
            F.get(F.col(f"places_{form}"), i - 1).alias("at"), F.lit(form).alias("form"), F.lit(n).alias("size"), F.xxhash64(F.slice(f"canon_{form}", i, n)).alias("h")))

    kinds = [(form, n) for form in forms for n in lengths]
    begun = templates.select("*", *[_starts(f, n).alias(f"starts_{f}_{n}") for f, n in kinds])
    found = [hashes(f, n) for f, n in kinds]
    one_array = begun.select("id", (found[0] if len(found) == 1 else F.concat(*found)).alias("windows"))
    # outer: for a plain explode Spark infers a filter on the array and evaluates the whole expression a second time, per
    # element, below the projections that hold its parts
    exploded = one_array.select("id", F.explode_outer("windows").alias("w")).where(F.col("w").isNotNull())
    return exploded.select("id", "w.at", "w.form", "w.size", "w.h")


def _pairs(cut: Column) -> Column:
    """Neighbours "w1 w2" among an array of tokens that both begin with a letter: the last run of letters of the first and the first
    run of the second. Letters whose small form depends on their place in a word make no pair."""
    def pair(t, i):
        after = F.get(cut, i + 1)
        joined = F.concat(F.regexp_extract(t, r"\p{L}+$", 0), F.lit(" "), F.regexp_extract(after, r"^\p{L}+", 0))
        return F.when(t.rlike(r"^\p{L}") & after.rlike(r"^\p{L}") & ~F.concat(t, after).rlike(r"[σςΣİ\p{M}]"), joined)

    return F.array_distinct(F.filter(F.transform(cut, pair), lambda x: x.isNotNull()))


def _item_windows(listed: DataFrame, form: str, window: int) -> DataFrame:
    """(id, at, form, size, h, pairs, ordinary) of the items' windows: window tokens, or all of a shorter item. ``form`` word or plain; name as word, all its windows."""
    canon = F.col(f"canon_{form}")
    n = F.least(F.size(canon), F.lit(window))
    each = listed.where(F.size(canon) > 0).select("id", canon.alias("canon"), f"places_{form}", n.alias("size"), F.explode(F.sequence(F.lit(1), F.size(canon) - n + 1)).alias("i"))
    cut = F.slice("canon", F.col("i"), F.col("size"))
    ordinary = F.size(F.filter(cut, lambda t: ~t.isin("<num>", "<unit>", "<name>")))
    return each.select("id", F.get(f"places_{form}", F.col("i") - 1).alias("at"), F.lit(form).alias("form"), "size", F.xxhash64(cut).alias("h"), _pairs(cut).alias("pairs"), ordinary.alias("ordinary"))


def _slots(rows: DataFrame) -> DataFrame:
    """rows (id, text) -> (id, slots): for each form, in order, (kind, value, place, whether it opens a sentence) of the canonical tokens."""
    held = _templates(rows, "toks", "kinds")

    def listed(form: str) -> Column:
        places = F.col(f"places_{form}")

        def slot(i, k):
            run = F.slice("toks", i, F.coalesce(F.get(places, k + 1), F.size("toks") + 1) - i)
            kind = F.get("kinds", i - 1)  # not canon: Spark would evaluate all of it anew for each token
            kind = F.when(kind == AFTER, "<name>").when(kind.startswith(OPENER), "<name>" if form == "name" else kind).otherwise(kind)
            return F.struct(kind.alias("kind"), F.lower(F.array_join(F.filter(run, lambda t: ~t.isin(ENDS)), " ")).alias("value"),
                            i.alias("place"), F.get("kinds", i - 1).startswith(OPENER).alias("opens"))

        return F.transform(places, slot)

    return held.select("id", listed("word").alias("word"), listed("name").alias("name"))


def _keyed(rows: DataFrame, text_col: str) -> DataFrame:
    """(id, text) with the text's digest as id."""
    text = F.col(text_col).cast("string")
    return rows.select(F.md5(text).alias("id"), text.alias("text"))


def _matches(texts: DataFrame, own: DataFrame) -> DataFrame:
    """(id, item, at, item_at, form, item_form, size): windows of texts (id, text) that are windows of items."""
    template = F.col("form") != "plain"
    sizes = {(r.form == "plain", r["size"]) for r in own.select("form", "size").distinct().collect()}  # a line for each length below WINDOW
    streams = []
    for literal in (False, True):
        lengths = sorted(n for k, n in sizes if k == literal)
        if lengths:
            given = _literals(texts) if literal else _templates(texts)
            # a window without a sentence opener is the same in both forms: it is sought as a word
            mine = own.where(~template if literal else template).withColumnRenamed("form", "item_form").drop("pairs")
            streams.append(_windows(given, ["plain"] if literal else ["word", "name"], lengths).join(maybe_broadcast(mine, MOST_BROADCAST), ["h", "size"]))
    columns = ["id", "item", "at", "item_at", "form", "item_form", "size"]
    if not streams:
        return texts.sparkSession.createDataFrame([], "id string, item string, at int, item_at int, form string, item_form string, size int")
    return streams[0].select(*columns) if len(streams) == 1 else streams[0].select(*columns).unionByName(streams[1].select(*columns))


def _word_pairs(texts: DataFrame, sought: DataFrame) -> DataFrame:
    """texts (id, text) -> (id, pair): the pairs "a b" of ``sought`` among the neighbouring runs of letters, in lower case, of each text."""
    first = sought.select(F.substring_index("pair", " ", 1).alias("w")).distinct().limit(MOST_FIRST + 1).collect()
    letters = F.trim(F.lower(F.regexp_replace("text", r"[^\p{L}]++", " ")))
    words = texts.select("id", F.split(letters, " ").alias("a"))
    near = words.select("id", F.arrays_zip(F.slice("a", 1, F.greatest(F.size("a") - 1, F.lit(0))).alias("a"), F.slice("a", 2, F.size("a")).alias("b")).alias("near"))
    if len(first) <= MOST_FIRST:  # cheaper than a row for each pair of the text; the join alone decides
        near = near.select("id", F.filter("near", lambda z: z["a"].isin([r.w for r in first])).alias("near"))
    # outer, and no condition on the arrays: Spark would push it down and cut all words a second time
    each = near.select("id", F.inline_outer("near")).toDF("id", "a", "b").where(F.col("b").isNotNull())
    return each.select("id", F.concat("a", F.lit(" "), "b").alias("pair")).join(maybe_broadcast(sought, MOST_BROADCAST), "pair").distinct()


def _candidates(texts: DataFrame, own: DataFrame, coverage: float) -> DataFrame:
    """texts (id, text), own (item, item_at, form, size, h, pairs) -> (id): texts that hold all pairs of so many windows of an item
    that they could be a hit, one window at least with pairs of its own."""
    paired = own.where(F.size("pairs") > 0)
    # every window has an anchor, its rarest pair as far as a few texts tell; texts without any are done
    sought = stage(paired.select(F.explode("pairs").alias("pair")).distinct(), "sought")
    common = _word_pairs(texts.limit(SAMPLE), sought).groupBy("pair").agg(F.count("*").alias("texts"))
    known = paired.select("pairs").distinct().withColumn("pair", F.explode("pairs")).join(maybe_broadcast(stage(common, "common"), MOST_BROADCAST), "pair", "left")
    anchors = known.groupBy("pairs").agg(F.min_by("pair", F.struct(F.coalesce("texts", F.lit(0)), -F.length("pair"), "pair")).alias("pair"))
    anchors = stage(anchors.select("pair").distinct(), "anchors")
    anchored = _word_pairs(texts, anchors).select("id").distinct()
    some = texts.join(maybe_broadcast(stage(anchored, "anchored"), MOST_BROADCAST), "id", "left_semi").dropDuplicates(["id"])
    found = stage(_word_pairs(some, sought), "pairs")
    rarity = found.groupBy("pair").agg(F.count("*").alias("texts"))
    windows = paired.select("item", "pairs").distinct()
    # a window with a pair that no text has is nowhere
    each = windows.withColumn("pair", F.explode("pairs")).join(rarity, "pair", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    rarest = each.groupBy("item", "pairs").agg(F.min_by("pair", F.struct("texts", "pair")).alias("pair"), F.min("texts").alias("least")).where("least > 0")
    of_text = stage(found.groupBy("id").agg(F.collect_set("pair").alias("held")), "held-pairs")
    likely = found.join(maybe_broadcast(rarest.select("pair", "pairs", "item"), MOST_BROADCAST), "pair").join(of_text, "id")
    likely = likely.where(F.size(F.array_except("pairs", "held")) == 0).select("id", "item").distinct()
    template = F.col("form") != "plain"
    held = F.size(F.array_except("pairs", "held")) == 0  # so is a window without pairs
    count = lambda c: F.countDistinct(F.when(c, F.col("item_at")))
    shares = likely.join(of_text, "id").join(own.select("item", "item_at", "form", "pairs"), "item").groupBy("id", "item").agg(
        (count(held) / F.countDistinct("item_at")).alias("of_all"), F.try_divide(count(held & template).cast("double"), count(template).cast("double")).alias("of_templates"))
    return shares.where(F.greatest("of_all", "of_templates") >= coverage).select("id").distinct()


def _decisions(docs: DataFrame, items: DataFrame, text_col: str, window: int, literals: int, coverage: float) -> DataFrame:
    """(id, item, n, share, verbatim, consistent), digests of texts for ids, for every document and item it contains; the best candidate counts."""
    every = _keyed(docs, text_col)
    questions = stage(_keyed(items, text_col).where(F.col("text").isNotNull()).dropDuplicates(["id"]), "items")
    # staged, as Spark would evaluate the nested expressions anew for each window
    listed = stage(_templates(questions).join(_literals(questions), "id"), "templates")
    words, names = _item_windows(listed, "word", window), _item_windows(listed.where(F.size("opens") > 0), "name", window)
    own = words.unionByName(names).where(F.col("ordinary") >= F.least(F.lit(literals), F.col("size"))).drop("ordinary").distinct()
    plain = _item_windows(listed, "plain", window).drop("ordinary").join(own.select("id", "at").distinct(), ["id", "at"], "left_anti")
    own = stage(own.unionByName(plain).select(F.col("id").alias("item"), F.col("at").alias("item_at"), "form", "size", "h", "pairs"), "windows")
    template = F.col("form") != "plain"
    loose = F.size("pairs") == 0
    count = lambda c: F.countDistinct(F.when(c, F.col("item_at")))
    totals = own.groupBy("item").agg(F.countDistinct("item_at").alias("total"), count(template).alias("templates"), F.max(F.col("item_at") + F.col("size")).alias("long"),
                                     count(loose).alias("loose"), count(loose & template).alias("loose_templates"))
    by_loose = totals.where((F.col("loose") / F.col("total") >= coverage) | (F.col("templates") > 0) & (F.col("loose_templates") / F.col("templates") >= coverage))
    totals = maybe_broadcast(totals.select("item", "total", "templates", "long"), MOST_BROADCAST)
    held = _candidates(every, own, coverage)
    sought = stage(own.where(loose).join(by_loose.select("item"), "item", "left_semi"), "loose-windows")
    if sought.limit(1).count():
        held = held.union(_matches(every, sought).select("id")).distinct()
    chosen = maybe_broadcast(stage(held, "candidates"), MOST_BROADCAST)
    texts = stage(every.join(chosen, "id", "left_semi").dropDuplicates(["id"]), "candidate-texts")
    matched = _matches(texts, own).distinct().withColumn("shift", F.col("at") - F.col("item_at"))
    pair = Window.partitionBy("id", "item").orderBy("shift")
    apart = F.col("shift") - F.lag("shift").over(pair) > F.greatest(F.lit(window), F.col("long") / 2)
    chained = matched.join(totals, "item").withColumn("apart", apart.cast("int"))
    chained = stage(chained.withColumn("chain", F.sum(F.coalesce("apart", F.lit(0))).over(pair)), "matched")
    n, n_templates = F.countDistinct("item_at").alias("n"), F.countDistinct(F.when(template, F.col("item_at"))).alias("n_templates")
    diagonal = chained.groupBy("id", "item", "chain", "shift", "total", "templates").agg(n, n_templates)
    chain = chained.groupBy("id", "item", "chain", F.lit(None).cast("int").alias("shift"), "total", "templates").agg(n, n_templates)
    share = F.greatest(F.col("n") / F.col("total"), F.when(F.col("templates") > 0, F.col("n_templates") / F.col("templates")))
    hits = stage(diagonal.unionByName(chain).withColumn("share", share).where(F.col("share") >= coverage), "hits")

    # word for word, or with other values; the former need no comparison of slots
    said = _running(texts).select("id", F.col("running").alias("said"))
    asked = _running(questions).select(F.col("id").alias("item"), F.col("running").alias("asked"))
    found = hits.groupBy("id", "item").agg(F.max(F.struct("n", "share")).alias("b"))
    found = found.join(said, "id").join(asked, "item").select("id", "item", F.col("b.n").cast("bigint").alias("n"), F.col("b.share").alias("share"), F.contains("said", "asked").alias("verbatim"))
    found = stage(found, "found")
    exact = found.where("verbatim").withColumn("consistent", F.lit(True))
    other = found.where(~F.col("verbatim")).select("id", "item")
    if other.isEmpty():
        return exact
    hits = hits.join(other, ["id", "item"], "left_semi")

    # for each item window of a candidate one place in the text: on the diagonal with most windows
    of_diagonal = diagonal.select("id", "item", "chain", "shift", F.col("n").alias("weight"))
    weighed = chained.join(hits.select("id", "item", "chain").distinct(), ["id", "item", "chain"], "left_semi").join(of_diagonal, ["id", "item", "chain", "shift"])
    cell = F.struct("at", "item_at", "form", "item_form", "size")
    in_chain = weighed.groupBy("id", "item", "chain", "item_at").agg(F.max_by(cell, F.struct("weight", -F.col("shift"), F.col("form") == "word")).alias("cell"))
    in_chain = in_chain.groupBy("id", "item", "chain").agg(F.collect_list("cell").alias("cells")).withColumn("shift", F.lit(None).cast("int"))
    in_diagonal = weighed.groupBy("id", "item", "chain", "shift", "item_at").agg(F.max_by(cell, F.struct(F.col("form") == "word", F.col("item_form") == "word")).alias("cell"))
    in_diagonal = in_diagonal.groupBy("id", "item", "chain", "shift").agg(F.collect_list("cell").alias("cells"))
    cells = in_chain.unionByName(in_diagonal).select("id", "item", "chain", "cells", F.col("shift").alias("of_shift"))
    placed = hits.join(cells, ["id", "item", "chain"]).where(F.col("shift").eqNullSafe(F.col("of_shift")))

    with_hits = texts.join(maybe_broadcast(hits.select("id").distinct(), MOST_BROADCAST), "id", "left_semi").dropDuplicates(["id"])
    in_doc = _slots(with_hits).select("id", F.col("word").alias("doc_word"), F.col("name").alias("doc_name"))
    in_item = _slots(questions).select(F.col("id").alias("item"), F.col("word").alias("item_word"), F.col("name").alias("item_name"))
    pairs = placed.join(in_doc, "id").join(in_item, "item")

    def filled(c):
        said, asked = F.when(c["form"] == "name", F.col("doc_name")).otherwise(F.col("doc_word")), F.when(c["item_form"] == "name", F.col("item_name")).otherwise(F.col("item_word"))

        def part(slots, at):
            return F.slice(slots, F.array_position(F.transform(slots, lambda x: x["place"]), at).cast("int"), c["size"])

        return F.zip_with(part(asked, c["item_at"]), part(said, c["at"]), lambda a, b: F.struct(a["kind"].alias("kind"), a["value"].alias("asked"), b["value"].alias("said"), (a["opens"] | b["opens"]).alias("opens")))

    # plain windows are equal as they are
    all_filled = F.flatten(F.transform(F.filter("cells", lambda c: c["form"] != "plain"), filled))
    pairs = pairs.withColumn("filled", F.array_distinct(F.filter(all_filled, lambda x: x["kind"].isin("<num>", "<unit>", "<name>"))))
    held = F.array_distinct(F.transform(F.filter("filled", lambda x: ~x["opens"]), lambda x: F.struct(x["kind"], x["asked"], x["said"])))
    pairs = pairs.withColumn("held", held)
    consistent = F.size(F.array_distinct(F.transform("held", lambda x: F.struct(x["kind"], x["asked"])))) == F.size("held")
    judged = pairs.select("id", "item", "n", "share", consistent.alias("consistent"))
    best = judged.groupBy("id", "item").agg(F.max(F.struct("consistent", "n", "share")).alias("b"))
    whole = best.select("id", "item", F.col("b.n").cast("bigint").alias("n"), F.col("b.share").alias("share"), F.col("b.consistent").alias("consistent"))
    return stage(exact.unionByName(whole.withColumn("verbatim", F.lit(False))), "decisions")


def _running(rows: DataFrame) -> DataFrame:
    """(id, running): the tokens as they are, between spaces, without sentence ends."""
    return rows.select("id", F.concat(F.lit(" "), F.array_join(F.filter(tokens(F.col("text")), lambda t: ~t.isin(ENDS)), " "), F.lit(" ")).alias("running"))


def contaminated(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW, literals: int = LITERALS, coverage: float = COVERAGE) -> DataFrame:
    """(doc_col, item_col, n_windows, coverage, verbatim, consistent) for every document and item it contains; the best candidate counts."""
    decided = _decisions(docs, items, text_col, window, literals, coverage)
    asked = items.select(F.md5(F.col(text_col).cast("string")).alias("item"), F.col(item_col).alias("_item"))
    named = maybe_broadcast(decided.join(asked, "item"), MOST_BROADCAST)
    ids = docs.select(F.md5(F.col(text_col).cast("string")).alias("id"), F.col(doc_col).alias("_doc"))
    best = ids.join(named, "id").groupBy("_doc", "_item").agg(F.max(F.struct("verbatim", "consistent", "n", "share")).alias("b"))
    return best.select(F.col("_doc").alias(doc_col), F.col("_item").alias(item_col), F.col("b.n").alias("n_windows"), F.col("b.share").alias("coverage"),
                       F.col("b.verbatim").alias("verbatim"), F.col("b.consistent").alias("consistent"))


def without_contaminated(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that hold no benchmark item."""
    flagged = _decisions(docs, items, text_col, WINDOW, LITERALS, COVERAGE).select(F.col("id").alias("_flagged")).distinct()
    return docs.join(maybe_broadcast(flagged, MOST_BROADCAST), F.md5(docs[text_col].cast("string")) == flagged["_flagged"], "left_anti")
