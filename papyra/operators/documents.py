"""Documents of several pages: links between blocks, joined tables, verification against rules."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.geometry import box
from papyra.functions.numbers import canonical_decimal
from papyra.functions.paging import by_page
from papyra.functions.text import collapse_space
from papyra.operators.reading_order import sequence_edges
from papyra.operators.spatial import smallest_containers

PAGE = ["doc_id", "page_number"]
# fixed values: shares of the page, the largest sum, and the budgets of a verification
ALIGNED, TOP, BOTTOM = 0.03, 0.15, 0.85
LARGEST = Decimal("79228162514264337593543950335")
MOST_RULES, MOST_REFERENCES, MOST_REREADS, MOST_PIXELS = 64, 256, 16, 16_000_000


def _other(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", *[F.col(c).alias(f"o_{c}") for c in blocks.columns if c != "doc_id"])


def _aligned(width: float):
    return (F.abs(F.col("min_x") - F.col("o_min_x")) / width <= ALIGNED) & (F.abs(F.col("max_x") - F.col("o_max_x")) / width <= ALIGNED)


def repeated_headers(blocks: DataFrame, width: float = 1000.0, height: float = 1000.0) -> DataFrame:
    """Header blocks of the same text, white space aside, in the top 15 % of two pages, with sides within 3 %."""
    h = blocks.filter((F.col("type") == "Header") & (F.col("max_y") <= TOP * height)).withColumn("n", collapse_space(F.coalesce("text", F.lit("")))).filter("n <> ''")
    h = h.select("doc_id", "page_number", "block_index", "min_x", "max_x", "n")
    pairs = h.join(_other(h).withColumnRenamed("o_n", "n"), ["doc_id", "n"])
    pairs = pairs.filter((F.col("page_number") < F.col("o_page_number")) & _aligned(width))
    return pairs.select("doc_id", F.col("page_number").alias("from_page"), F.col("block_index").alias("from_block"), F.col("o_page_number").alias("to_page"), F.col("o_block_index").alias("to_block"))


def table_continuations(blocks: DataFrame, width: float = 1000.0, height: float = 1000.0, columns: str = "column_count", first_row: str = "first_row") -> DataFrame:
    """A table in the bottom 15 % of a page and one in the top 15 % of the next, aligned, with as many columns, two at least."""
    t = blocks.filter((F.col("type") == "Table") & (F.col(columns) >= 2))
    t = t.select("doc_id", "page_number", "block_index", "min_x", "min_y", "max_x", "max_y", F.col(columns).alias("c"), F.col(first_row).alias("f"))
    nxt = _other(t).withColumn("page_number", F.col("o_page_number") - 1).withColumnRenamed("o_c", "c")
    pairs = t.join(nxt, ["doc_id", "page_number", "c"]).filter((F.col("max_y") >= BOTTOM * height) & (F.col("o_min_y") <= TOP * height) & _aligned(width))
    same = F.coalesce(F.forall(F.arrays_zip("f", F.col("o_f").alias("g")), lambda z: (collapse_space(z["f"]) != "") & (collapse_space(z["f"]) == collapse_space(z["g"]))), F.lit(False))
    evidence = F.concat(F.lit("Adjacent pages, bottom/top 15%, aligned horizontal edges, "), F.col("c"), F.lit(" columns; "), F.when(same, "identical first-row text").otherwise("first-row text differs or contains merged cells"))
    return pairs.select("doc_id", F.col("page_number").alias("from_page"), F.col("block_index").alias("from_block"), F.col("o_page_number").alias("to_page"), F.col("o_block_index").alias("to_block"), evidence.alias("evidence"))


def assemble(blocks: DataFrame, width: float = 1000.0, height: float = 1000.0, tables: bool = False) -> DataFrame:
    """All links of the documents: kind, from and to block, evidence, requires_review. Nothing is merged."""
    link = lambda df, kind, evidence, review: df.select("doc_id", F.lit(kind).alias("kind"), "from_page", "from_block", "to_page", "to_block", evidence.alias("evidence"), F.lit(review).alias("requires_review"))
    on_page = lambda df, a, b: df.select("doc_id", F.col("page_number").alias("from_page"), F.col(a).alias("from_block"), F.col("page_number").alias("to_page"), F.col(b).alias("to_block"))
    out = link(on_page(sequence_edges(blocks, PAGE), "from_block", "to_block"), "Sequence", F.lit("Existing page reading order"), False)
    out = out.union(link(on_page(smallest_containers(blocks, PAGE), "container", "block_index"), "Contains", F.lit("Strict bounding-box containment; semantic ownership unconfirmed"), True))
    out = out.union(link(repeated_headers(blocks, width, height), "RepeatedHeader", F.lit("Header labels, identical normalized text, top 15%, horizontal edges within 3% of page width"), True))
    if tables:
        out = out.union(link(table_continuations(blocks, width, height), "TableContinuationCandidate", F.col("evidence"), True))
    return out


def orphan_lines(structure: DataFrame, page: DataFrame) -> DataFrame:
    """Orphan lines of both sources, each evidence once."""
    return structure.unionByName(page).dropDuplicates()


def approved_chains(links: DataFrame) -> DataFrame:
    """doc_id, chain, position, page, block: the paths that approved links make, each from the table that none continues on, of any length.

    links: doc_id, from_page, from_block, to_page, to_block. Reading the rows fails for a document whose links branch or
    repeat, or don't lead to the next page. All of a document's links are followed in one pass.
    """
    types = dict(links.dtypes)

    def walk(rows: list[dict]):
        onward = {(r["from_page"], r["from_block"]): (r["to_page"], r["to_block"]) for r in rows}
        reached = set(onward.values())
        if len(onward) < len(rows) or len(reached) < len(rows):
            raise ValueError("ambiguous links: a table continues in two, or two in one")
        if any(to[0] != at[0] + 1 for at, to in onward.items()):
            raise ValueError("a table continues on the next page only")
        for head in sorted(set(onward) - reached):
            place, position = head, 0
            while place:
                yield {"doc_id": rows[0]["doc_id"], "chain": {"from_page": head[0], "from_block": head[1]}, "position": position, "page": place[0], "block": place[1]}
                place, position = onward.get(place), position + 1

    page, block = types["from_page"], types["from_block"]
    slim = links.select("doc_id", "from_page", "from_block", "to_page", "to_block")
    return by_page(slim, ["doc_id"], ["from_page", "from_block"], walk, f"doc_id {types['doc_id']}, chain struct<from_page:{page},from_block:{block}>, position int, page {page}, block {block}")


def _chained(cells: DataFrame, chains: DataFrame) -> DataFrame:
    """cells of chains with position and the row their table starts at in the joined one; an error for tables that don't belong together."""
    c = cells.join(chains, ["doc_id", "page", "block"])
    chain = ["doc_id", "chain"]
    head = F.when(F.col("row") == 0, F.struct("col", "col_span", "row_span", collapse_space(F.col("text")).alias("text")))
    t = c.groupBy(*chain, "position").agg(F.max(F.col("row") + F.col("row_span")).alias("n"), F.max(F.col("col") + F.col("col_span")).alias("width"), F.array_sort(F.collect_list(head)).alias("head"))
    w = Window.partitionBy(*chain).orderBy("position")
    other = (F.lag("width").over(w) != F.col("width")) | (F.lag("head").over(w) != F.col("head"))
    kept = F.col("n") - (F.col("position") > 0).cast("int")
    first = F.sum(kept).over(w) - F.col("n")  # rows before, less the header that goes
    t = t.select(*chain, "position", F.when(F.coalesce(other, F.lit(False)), F.raise_error(F.lit("joined tables need as many columns and the same first row")).cast("long")).otherwise(first).alias("first"))
    return c.join(t, [*chain, "position"])


def join_tables(cells: DataFrame, chains: DataFrame) -> DataFrame:
    """The cells of each chain's tables as one: rows go on, and the first row of each later table, which must repeat the first one's, is left out.

    cells: doc_id, page, block, row, col, row_span, col_span, text. Reading fails if column counts, or the texts,
    columns and spans of first rows differ within a chain. See omitted_headers for what was left out.
    """
    out = _chained(cells, chains).filter((F.col("position") == 0) | (F.col("row") > 0))
    return out.select("doc_id", "chain", "page", "block", (F.col("row") + F.col("first")).cast("int").alias("row"), "col", "row_span", "col_span", "text")


def omitted_headers(cells: DataFrame, chains: DataFrame) -> DataFrame:
    """The cells of first rows that join_tables leaves out."""
    out = _chained(cells, chains).filter((F.col("position") > 0) & (F.col("row") == 0) & F.col("first").isNotNull())
    return out.select("doc_id", "chain", "page", "block", "col", "row_span", "col_span", "text")


def check_rules(rules: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, rule_ordinal, id, kind, status of each rule.

    rules: doc_id, rule_ordinal, id, kind (DecimalSum, ExactText), inputs array<struct<page_number,block_index>>,
    expected struct<page_number,block_index>, tolerance decimal. A missing block or a blank text is unverifiable, as is
    a text that is no exact decimal and a sum beyond the largest number; else the sum or text agrees or contradicts.
    """
    ref = rules.select("doc_id", "rule_ordinal", F.posexplode(F.concat(F.col("inputs"), F.array("expected"))).alias("pos", "ref"), F.size("inputs").alias("n_in"))
    b = blocks.select("doc_id", "page_number", "block_index", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("there"))
    read = ref.select("*", "ref.*").join(b, ["doc_id", "page_number", "block_index"], "left")
    d = canonical_decimal(F.col("text"))
    last = F.col("pos") == F.col("n_in")
    g = read.groupBy("doc_id", "rule_ordinal").agg(
        F.bool_or(F.col("there").isNull()).alias("missing"), F.bool_or(F.trim("text") == "").alias("blank"), F.bool_or(d.isNull()).alias("inexact"),
        F.sum(F.when(~last, d)).alias("total"), F.max(F.when(last, d)).alias("wanted"), F.max(F.when(last, F.col("text"))).alias("wanted_text"),
        F.min(F.when(~last, F.col("text"))).alias("least_text"), F.max(F.when(~last, F.col("text"))).alias("most_text"),
    )
    r = rules.join(g, ["doc_id", "rule_ordinal"], "left")
    is_sum = F.col("kind") == "DecimalSum"
    agrees = F.when(is_sum, F.abs(F.col("total") - F.col("wanted")) <= F.coalesce("tolerance", F.lit(0))).otherwise((F.col("least_text") == F.col("wanted_text")) & (F.col("most_text") == F.col("wanted_text")))
    status = (
        F.when(F.col("missing"), "missing-reading").when(F.col("blank"), "blank-reading").when(is_sum & F.col("inexact"), "not-a-decimal")
        .when(is_sum & (F.col("total").isNull() | (F.abs("total") > F.lit(LARGEST))), "decimal-overflow").when(agrees, "agreement").otherwise("contradiction")
    )
    return r.select("doc_id", "rule_ordinal", "id", "kind", status.alias("status"))


def reread_requests(rules: DataFrame, checks: DataFrame, blocks: DataFrame, width: float, height: float, most_rules: int = MOST_RULES, most_references: int = MOST_REFERENCES, most_rereads: int = MOST_REREADS, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """doc_id, rule_ordinal, page_number, block_index, pixels: what failing rules ask to read again, once each, in order, within the budgets.

    A reading needs bounds with an area on the page; whole pixels that cover it count. Budgets are used up in the order
    of rules and references, so a document's rules are gone through one by one.
    """
    failing = checks.filter("status = 'contradiction'").select("doc_id", "rule_ordinal")
    ref = rules.filter(F.col("rule_ordinal") < most_rules).join(failing, ["doc_id", "rule_ordinal"], "left_semi")
    ref = ref.select("doc_id", "rule_ordinal", F.posexplode(F.concat(F.col("inputs"), F.array("expected"))).alias("pos", "ref")).select("doc_id", "rule_ordinal", "pos", "ref.*")
    ref = ref.join(blocks.select(*PAGE, "block_index", "min_x", "min_y", "max_x", "max_y"), [*PAGE, "block_index"])
    b = box()
    ok = (b.min_x >= 0) & (b.min_y >= 0) & (b.max_x <= width) & (b.max_y <= height) & ~b.empty
    ref = ref.filter(ok).withColumn("pixels", ((F.ceil("max_x") - F.floor("min_x")) * (F.ceil("max_y") - F.floor("min_y"))).cast("long"))

    def spend(rows: list[dict]):
        seen, pixels = set(), 0
        for r in rows[:most_references]:
            place = r["page_number"], r["block_index"]
            if place in seen or len(seen) >= most_rereads or pixels + r["pixels"] > most_pixels:
                continue
            seen.add(place)
            pixels += r["pixels"]
            yield r

    keep = ref.select("doc_id", "rule_ordinal", "pos", "page_number", "block_index", "pixels")
    return by_page(keep, ["doc_id"], ["rule_ordinal", "pos"], spend, keep.schema).drop("pos")
