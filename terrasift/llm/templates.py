"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, units after numbers, and names (capitalised words inside a sentence) become typed
slots; what remains is lower-cased and stripped of punctuation. Windows of the resulting
templates meet in a hash join, the templates themselves confirm, and the slots decide: within
an occurrence, or a document, every value of an item has to stand for one document value, so a
question with other numbers or names is caught and a chance meeting of templates is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.llm.tables import keep

SLOT = "\x01"
SPACE = r"[ \t-\r]+"
# Units that may follow a number.
UNITS = (
    "kilograms kilogram grams gram kg mg g tons ton pounds pound lb kilometers kilometres km meters metres meter metre m "
    "centimeters cm mm miles mile feet foot ft inches inch hours hour hrs minutes minute min seconds second sec days day "
    "weeks week months month years year liters litres liter litre ml l percent dollars dollar euros euro cents cent degrees degree"
).split()
NAME = r"\p{Lu}\p{Ll}\p{L}*"
DIGITS = r"[0-9]+(?:[.,:/][0-9]+)*"
UNIT = "(" + SLOT + r"d[0-9.,:/]+ ?)(" + "|".join(UNITS) + r")(?!\p{L})"


def rich_text(text: Column) -> Column:
    """Lower-cased words without punctuation; a slot is its mark, its kind (n, d, u) and its value."""
    named = F.regexp_replace(text, r"(?<=[^.!?: \t-\r][ \t-\r])(" + NAME + ")", SLOT + "n$1")
    numbered = F.regexp_replace(F.regexp_replace(named, f"({DIGITS})", SLOT + "d$1"), UNIT, "$1" + SLOT + "u$2")
    marked = F.when(text.rlike("[0-9]"), numbered).otherwise(named)
    return F.lower(F.regexp_replace(marked, r"[^\p{L}\p{M}\p{N}\x01 \t-\r]+", ""))


def template_text(rich: Column) -> Column:
    """The same words with the slots' values taken out."""
    bare = F.regexp_replace(rich, SLOT + r"([ndu])[\p{L}\p{M}\p{N}]*", SLOT + "$1")
    return F.when(F.contains(rich, F.lit(SLOT)), bare).otherwise(rich)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def plain_text(text: Column) -> Column:
    """Lower-cased words without punctuation and slots; word for word beside ``rich_text``."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}\x01 \t-\r]+", ""))


WINDOWS = "array<struct<size:int,pos:int,hash:bigint>>"
WHOLE = -(1 << 30)  # stands for the whole document among the alignments


def _hashes(tokens: Column, size: int, starts: Column | None = None) -> Column:
    """Array of (size, position, hash) of all windows of ``size`` words, or of those at ``starts``."""
    starts = F.sequence(F.lit(1), F.size(tokens) - size + 1) if starts is None else starts
    each = F.transform(
        starts, lambda i: F.struct(F.lit(size).alias("size"), i.alias("pos"), F.xxhash64(F.slice(tokens, i, size)).alias("hash"))
    )
    return F.when(F.size(tokens) >= size, each).otherwise(F.array().cast(WINDOWS))


def _around_slots(tokens: Column, size: int) -> Column:
    """Starts of the windows of ``size`` words that hold a slot; the others are plain already."""
    places = F.filter(F.transform(tokens, lambda w, i: F.when(F.contains(w, F.lit(SLOT)), i + 1)), lambda i: i.isNotNull())
    last = F.size(tokens) - size + 1
    near = lambda i: F.filter(F.sequence(F.greatest(F.lit(1), i - size + 1), i), lambda k: k <= last)
    return F.array_distinct(F.flatten(F.transform(places, near)))


def item_windows(items: DataFrame, window: int, least_words: int, least_literals: int, any_form: bool) -> DataFrame:
    """``(item_id, size, pos, kind, hash, key, rich)`` of all windows.

    Windows that hold enough plain words beside their slots have a row of kind t, by their
    template; the others, and with ``any_form`` all, have one of kind p, by their plain words.
    """
    own = (
        items.select("item_id", rich_text(F.col("text")).alias("rich_text"), words(plain_text(F.col("text"))).alias("plain"))
        .select("item_id", words(template_text(F.col("rich_text"))).alias("template"), words(F.col("rich_text")).alias("rich"), "plain")
        .where(F.size("template") > 0)
        .withColumn("length", F.size("template"))
        .withColumn("size", F.least(F.lit(window), F.size("template")))
        .withColumn("pos", F.explode(F.sequence(F.lit(1), F.size("template") - F.col("size") + 1)))
        .withColumns({c: F.slice(c, F.col("pos"), F.col("size")) for c in ("template", "rich", "plain")})
    )
    literals = F.size(F.filter("template", lambda w: ~F.contains(w, F.lit(SLOT))))
    enough = (F.col("length") >= least_words) & (literals >= F.least(F.lit(least_literals), F.col("size")))
    form = lambda df, kind, key: df.select(
        "item_id", "size", "pos", F.lit(kind).alias("kind"), F.xxhash64(key).alias("hash"), F.col(key).alias("key"), "rich"
    )
    exact = own if any_form else own.where(~enough)
    return form(exact, "p", "plain").unionByName(form(own.where(enough), "t", "template"))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 8,
    least_share: float = 0.5,
    least_words: int = 5,
    least_literals: int = 4,
    any_form: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """One row for each document row: its best item and whether it is contaminated by it.

    ``matched`` counts the item's windows found with consistent slots or, with ``any_form``,
    word for word (case and punctuation aside), so that copies in another case or layout count,
    too; ``share`` is their part of the item's windows, ``other_values`` tells that slots hold
    other values than the item's. Slots have to be consistent in the whole document
    or in one occurrence (windows equally far from their place in the item), whichever gives
    more. A document is contaminated from ``least_share`` on; the best item has the largest
    share, then most windows, then the smallest id. Items of fewer than ``least_words`` words
    and windows of fewer than ``least_literals`` plain words are too common as templates and
    count word for word only; the share is of all windows or of those with templates,
    whichever is larger. Null and empty texts match nothing, null item ids are left out, null
    document ids and repeated rows stay, empty tables give no rows or no matches, other columns
    are ignored.
    """
    items = benchmark.select(benchmark[item_id_column].alias("item_id"), benchmark[item_text_column].cast("string").alias("text"))
    probes, _ = keep(item_windows(items.where("item_id IS NOT NULL AND text IS NOT NULL").distinct(), window, least_words, least_literals, any_form))
    forms = sorted(map(tuple, probes.select("kind", "size").distinct().collect()))  # at most ``window`` sizes
    sizes, exact_sizes = sorted({n for _, n in forms}), [n for kind, n in forms if kind == "p"]
    row = F.xxhash64(docs[id_column], docs[text_column].cast("string"))
    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"), row.alias("row"))
    text = F.coalesce("text", F.lit(""))
    both = rows.select("row", words(template_text(rich_text(text))).alias("tokens"), words(plain_text(text)).alias("plain"))
    found = [_hashes(F.col("tokens"), n) for n in sizes]
    found += [_hashes(F.col("plain"), n, _around_slots(F.col("tokens"), n)) for n in exact_sizes]
    seen = both.select("row", F.explode(F.concat(F.array().cast(WINDOWS), *found)).alias("w")).select("row", "w.*")
    met, _ = keep(seen.join(probes.select("hash").distinct(), "hash", "left_semi").distinct())
    # the texts of documents with a meeting, once for each row key
    places = met.groupBy("row").agg(F.collect_set(F.struct("size", "pos", "hash")).alias("places"))
    again = rows.select("row", "text").join(places, "row").dropDuplicates(["row"])
    part = lambda c, p: F.slice(c, p["pos"], p["size"])
    cut = (
        again.select("row", "places", rich_text(F.col("text")).alias("r"), words(plain_text(F.col("text"))).alias("plain"))
        .select("row", "places", words(F.col("r")).alias("rich"), words(template_text(F.col("r"))).alias("template"), "plain")
        .select(
            "row",
            F.explode(
                F.transform(
                    "places",
                    lambda p: F.struct(
                        p["hash"].alias("hash"), p["pos"].alias("at"), part("template", p).alias("template"), part("rich", p).alias("doc_rich"), part("plain", p).alias("plain")
                    ),
                )
            ).alias("w"),
        )
        .select("row", "w.*")
    )
    same = F.col("key") == F.when(F.col("kind") == "t", F.col("template")).otherwise(F.col("plain"))
    pairs = cut.join(probes, "hash").where(same)
    pairs, _ = keep(pairs.select("row", "item_id", "kind", "pos", (F.col("at") - F.col("pos")).alias("run"), "rich", "doc_rich").distinct())
    slots = F.filter(F.zip_with("rich", "doc_rich", lambda a, b: F.struct(a.alias("item"), b.alias("doc"))), lambda x: F.contains(x["item"], F.lit(SLOT)))
    runs = pairs.where("kind = 't'").withColumn("run", F.explode(F.array(F.lit(WHOLE), F.col("run"))))
    filled = runs.drop("kind").distinct().withColumn("slots", slots)
    group = ["row", "item_id", "run"]
    votes = filled.select(*group, F.explode("slots").alias("s")).groupBy(*group, "s.item", "s.doc").count()
    ranked = Window.partitionBy(*group, "item").orderBy(F.desc("count"), "doc")
    chosen = votes.withColumn("k", F.row_number().over(ranked)).where("k = 1")
    meaning = chosen.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("item", "doc"))).alias("meaning"))
    fits = F.forall("slots", lambda s: F.coalesce(F.element_at("meaning", s["item"]) == s["doc"], F.lit(False)))
    agreed = (
        filled.join(meaning, group, "left")
        .where(fits)
        .groupBy(*group)
        .agg(F.collect_set("pos").alias("fitting"), F.max(F.exists("slots", lambda s: s["item"] != s["doc"])).alias("other_values"))
    )
    exact = pairs.where("kind = 'p'").groupBy("row", "item_id").agg(F.collect_set("pos").alias("exact"))
    whole = probes.groupBy("item_id").agg(F.countDistinct("pos").alias("windows"), F.collect_set(F.when(F.col("kind") == "t", F.col("pos"))).alias("rich_pos"))
    none = F.array().cast("array<int>")
    hits = agreed.join(exact, ["row", "item_id"], "full").withColumn("hits", F.array_union(F.coalesce("fitting", none), F.coalesce("exact", none)))
    # the share of all windows, and of those with templates
    ways = F.array(
        F.struct((F.size("hits") / F.col("windows")).alias("share"), F.size("hits").cast("bigint").alias("matched")),
        F.struct(
            F.coalesce(F.size(F.array_intersect("hits", "rich_pos")) / F.nullif(F.size("rich_pos"), F.lit(0)), F.lit(0.0)).alias("share"),
            F.size(F.array_intersect("hits", "rich_pos")).cast("bigint").alias("matched"),
        ),
    )
    shares = hits.join(whole, "item_id").withColumn("way", F.array_max(ways)).select(
        "row", "item_id", "way.matched", F.round("way.share", 6).alias("share"), F.coalesce("other_values", F.lit(False)).alias("other_values"), F.coalesce("run", F.lit(WHOLE)).alias("run")
    )
    order = F.struct(F.col("share"), F.col("matched"), -F.col("item_id"), (F.col("run") == WHOLE), ~F.col("other_values"), -F.col("run"))
    best = shares.groupBy("row").agg(F.max_by(F.struct("item_id", "matched", "share", "other_values"), order).alias("b"))
    return rows.select("doc_id", "row").join(best, "row", "left").select(
        "doc_id",
        F.col("b.item_id").alias("item_id"),
        F.coalesce("b.matched", F.lit(0)).cast("bigint").alias("matched"),
        F.coalesce("b.share", F.lit(0.0)).alias("share"),
        F.coalesce("b.other_values", F.lit(False)).alias("other_values"),
        (F.coalesce("b.share", F.lit(0.0)) >= least_share).alias("contaminated"),
        "row",
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates, all columns."""
    found, _ = keep(find_leaks(docs, benchmark, **options).where("contaminated").select("row").distinct())
    row = F.xxhash64(docs[options.get("id_column", "doc_id")], docs[options.get("text_column", "text")].cast("string"))
    return docs.join(found, row == found["row"], "left_anti")


def find_leaks_sql(window: int = 8, least_share: float = 0.5, least_words: int = 5, least_literals: int = 4) -> str:
    """SQL twin over ``documents`` and ``benchmark``; windows are compared as text."""
    mark = "chr(1)"

    def name(text: str) -> str:
        return f"regexp_replace({text}, '([^.!?: \\t-\\r][ \\t-\\r])({NAME})', '\\1' || {mark} || 'n\\2', 'g')"

    named = name(name("text"))
    numbered = f"regexp_replace({named}, '({DIGITS})', {mark} || 'd\\1', 'g')"
    units = "|".join(UNITS)
    # RE2 has no look-ahead: the character after the unit is taken along
    united = f"regexp_replace({numbered}, '(' || {mark} || 'd[0-9.,:/]+ ?)({units})([^\\p{{L}}]|$)', '\\1' || {mark} || 'u\\2\\3', 'g')"
    rich = f"lower(regexp_replace({united}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\x01 \\t-\\r]+', '', 'g'))"

    def tokens(text: str) -> str:
        return f"list_filter(regexp_split_to_array({text}, '[ \\t-\\r]+'), lambda w: w <> '')"

    template = f"regexp_replace(rich, {mark} || '([ndu])[\\p{{L}}\\p{{M}}\\p{{N}}]*', {mark} || '\\1', 'g')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {rich} AS rich FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
dt AS (SELECT r, {tokens(template)} AS t, {tokens("rich")} AS v FROM d),
i AS (SELECT item_id, {rich} AS rich FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
it AS (SELECT item_id, {tokens(template)} AS t, {tokens("rich")} AS v FROM i),
iw AS (
  SELECT item_id, size, pos, t[pos:pos + size - 1] AS t, v[pos:pos + size - 1] AS v
  FROM (SELECT *, least({window}, len(t)) AS size, unnest(range(1, len(t) - least({window}, len(t)) + 2)) AS pos FROM it WHERE len(t) >= {least_words})),
probe AS (
  SELECT *, array_to_string(t, ' ') AS key FROM iw
  WHERE len(list_filter(t, lambda w: NOT contains(w, {mark}))) >= least({least_literals}, size)),
sizes AS (SELECT DISTINCT size FROM probe),
dw AS (
  SELECT r, size, v[pos:pos + size - 1] AS dv, array_to_string(t[pos:pos + size - 1], ' ') AS key
  FROM (SELECT r, t, v, size, unnest(range(1, len(t) - size + 2)) AS pos FROM dt, sizes WHERE len(t) >= size)),
pairs AS (SELECT DISTINCT r, item_id, pos, v, dv FROM dw JOIN probe USING (key, size)),
slots AS (
  SELECT r, item_id, pos, dv, iv.v AS item, iv.d AS doc
  FROM (SELECT r, item_id, pos, dv, unnest(list_transform(range(1, len(v) + 1), lambda k: {{'v': v[k], 'd': dv[k]}})) AS iv FROM pairs)
  WHERE contains(iv.v, {mark})),
votes AS (SELECT r, item_id, item, doc, count(*) AS n FROM slots GROUP BY ALL),
chosen AS (SELECT r, item_id, item, doc FROM votes QUALIFY row_number() OVER (PARTITION BY r, item_id, item ORDER BY n DESC, doc) = 1),
wrong AS (
  SELECT DISTINCT s.r, s.item_id, s.pos, s.dv FROM slots s JOIN chosen c ON (s.r, s.item_id, s.item) = (c.r, c.item_id, c.item) WHERE s.doc <> c.doc),
changed AS (SELECT r, item_id, pos, dv, max(item <> doc) AS other FROM slots GROUP BY ALL),
agreed AS (
  SELECT p.r, p.item_id, count(DISTINCT p.pos) AS matched, max(coalesce(c.other, false)) AS other_values
  FROM pairs p ANTI JOIN wrong w ON (p.r, p.item_id, p.pos, p.dv) = (w.r, w.item_id, w.pos, w.dv)
  LEFT JOIN changed c ON (p.r, p.item_id, p.pos, p.dv) = (c.r, c.item_id, c.pos, c.dv) GROUP BY ALL),
shares AS (
  SELECT a.*, round(matched / windows, 6) AS share
  FROM agreed a JOIN (SELECT item_id, count(*) AS windows FROM probe GROUP BY ALL) USING (item_id)),
best AS (SELECT * FROM shares QUALIFY row_number() OVER (PARTITION BY r ORDER BY share DESC, matched DESC, item_id) = 1)
SELECT doc_id, item_id, coalesce(matched, 0)::BIGINT AS matched, coalesce(share, 0.0)::DOUBLE AS share,
  coalesce(other_values, false) AS other_values, coalesce(share, 0.0) >= {least_share} AS contaminated
FROM d LEFT JOIN best USING (r)"""
