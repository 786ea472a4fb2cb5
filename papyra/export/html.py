"""Pages as HTML documents, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.text import balanced_table, escape_html, table_fragment

HEAD = """<!DOCTYPE html>
<html lang="en">
<head>
  <meta charset="utf-8">
  <meta name="viewport" content="width=device-width, initial-scale=1">
  <meta name="generator" content="papyra">
  <title>%s</title>
  <style>
    body { font-family: sans-serif; line-height: 1.5; margin: 2rem auto; max-width: 50rem; }
    table { border-collapse: collapse; } table, th, td { border: 1px solid #bbb; }
    figure { border: 1px dashed #bbb; padding: 1rem; }
  </style>
</head>
<body>
"""


def escape(text: Column) -> Column:
    return F.replace(F.replace(escape_html(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def _number(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), r"\.$", "")


def render_block(image: Column | None = None) -> Column:
    """A block as markup, empty if it has nothing to show: headings, a table if its markup is balanced, formulas, figures, paragraphs.

    image: PNG bytes of a figure's cut-out, where the caller has them.
    """
    kind, text = F.col("type"), F.trim(F.coalesce("text", F.lit("")))
    tag = lambda name, body: F.when(text != "", F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))).otherwise("")
    fragment = table_fragment(F.col("table_html"))
    table = F.when(F.coalesce(balanced_table(fragment), F.lit(False)), fragment).when(text == "", "<table></table>").otherwise(tag("p", escape(text)))
    latex = escape(F.trim(F.coalesce("latex", F.lit(""))))
    formula = F.when(latex == "", "").otherwise(F.concat(F.lit('<div class="formula" data-latex="'), latex, F.lit('">\\[ '), latex, F.lit(" \\]</div>")))
    caption = F.concat(F.lit("<figcaption>"), escape(F.when(text == "", kind).otherwise(text)), F.lit("</figcaption>"))
    place = F.concat_ws(" ", *[_number(F.col(c)) for c in ("min_x", "min_y", "max_x", "max_y")])
    figure = F.concat(F.lit('<figure data-type="'), kind, F.lit('" data-bbox="'), place, F.lit('">'), caption, F.lit("</figure>"))
    if image is not None:
        shown = F.concat(F.lit('<figure><img src="data:image/png;base64,'), F.base64(image), F.lit('" alt="'), kind, F.lit('"/>'), F.when(text != "", caption).otherwise(""), F.lit("</figure>"))
        figure = F.when(image.isNotNull(), shown).otherwise(figure)
    out = F.when(kind == "DocTitle", tag("h1", escape(text))).when(kind.isin("Title", "Abstract"), tag("h2", escape(text))).when(kind == "Table", table)
    return out.when(kind == "Formula", formula).when(kind.isin("Figure", "Chart", "Seal"), figure).otherwise(tag("p", escape(text)))


def page_html(blocks: DataFrame, keys: list[str], order: str = "block_order", image: Column | None = None) -> DataFrame:
    """keys, html: blocks in order; the first title is the document's."""
    title = F.when(F.col("type").isin("DocTitle", "Title") & (F.trim("text") != ""), F.struct(order, F.trim("text").alias("t")))
    g = blocks.withColumn("_h", render_block(image)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.col("_h").alias("h")))).alias("b"), F.min(title).alias("t"))
    body = F.array_join(F.transform(F.filter(F.col("b.h"), lambda h: h != ""), lambda h: F.concat(F.lit("  "), h, F.lit("\n"))), "")
    head, tail = HEAD.split("%s")
    return g.select(*keys, F.concat(F.lit(head), escape(F.coalesce("t.t", F.lit("Document"))), F.lit(tail), body, F.lit("</body>\n</html>\n")).alias("html"))
