"""Frames the queries run on, derived from the given tables as a whole.

Invoices come from orders and their lines: the record is what the tables say,
the text is the same invoice printed with one kind of damage per
``doc_id % 8`` (see ``_NOISE``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A condition on the key of an order.
Some = Callable[[Column], Column] | None

_NOISE = """
0 clean                       1 supplier line blank
2 customer 'm' -> 'rn', line prices '0' -> 'O'
3 thousands commas            4 dd/MM/yyyy date, descriptions 'e' -> 'c'
5 total without decimals      6 no date in the record
7 negative total in the record, artefacts and double blanks in descriptions
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def money(x: Column) -> Column:
    return x.cast("decimal(18,2)").cast("string")


def with_separator(x: Column) -> Column:
    """Money text with one thousands comma."""
    return F.when(
        x >= 1000,
        F.concat(F.floor(x / 1000).cast("string"), F.lit(","), F.right(money(x), F.lit(6))),
    ).otherwise(money(x))


def orders(spark: SparkSession, sf_dir: str, some: Some = None) -> DataFrame:
    """The orders, or those for whose key ``some`` holds."""
    found = table(spark, sf_dir, "orders")
    return found.where(some(F.col("o_orderkey"))) if some else found


def _lines(spark: SparkSession, sf_dir: str, some: Some) -> DataFrame:
    """One row per order with its lines in a fixed order."""
    item = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )
    item = item.where(some(F.col("l_orderkey"))) if some else item
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    # columns that decide the order come first, so sorting the structs sorts the lines
    line = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
        "p_name", "p_retailprice", "s_name",
    )
    return (
        item.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.col("l_orderkey").alias("doc_id"))
        .agg(F.array_sort(F.collect_list(line)).alias("lines"))
    )


def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id`` of the invoices, without building them."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))


def _printed_line(v: Column, line: Column) -> Column:
    name, price = line["p_name"], money(line["l_extendedprice"])
    name = (
        F.when(v == 7, F.replace(name, F.lit(" "), F.lit("^{}[]  ")))
        .when(v == 4, F.translate(name, "e", "c"))
        .otherwise(name)
    )
    price = (
        F.when(v == 2, F.translate(price, "0", "O"))
        .when(v == 3, with_separator(line["l_extendedprice"]))
        .otherwise(price)
    )
    return F.concat(
        F.lit("| "), name, F.lit(" | "), line["l_quantity"].cast("bigint").cast("string"),
        F.lit(" | $"), price, F.lit(" |"),
    )


def invoices(spark: SparkSession, sf_dir: str, some: Some = None) -> DataFrame:
    """doc_id, the record columns, the printed parts, and the whole ``ocr_text``; of all orders, or those for whose key ``some`` holds."""
    order = orders(spark, sf_dir, some).select(
        F.col("o_orderkey").alias("doc_id"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    v, total = F.col("v"), F.col("o_totalprice")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    number = F.concat(F.lit("INV-"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    record = (
        # the customer first: lines are shuffled by the document alone
        order.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(_lines(spark, sf_dir, some), "doc_id", "left")
        .withColumn("v", F.pmod("o_orderkey", F.lit(8)).cast("int"))
        .withColumn("lines", F.coalesce("lines", F.array()))
        .select(
            "doc_id",
            "v",
            F.lit("invoice").alias("document_type"),
            number.alias("document_number"),
            F.when(v != 6, day).alias("document_date"),
            F.get("lines", F.lit(0))["s_name"].alias("supplier_name"),
            F.col("c_name").alias("customer_name"),
            F.when(v == 7, -total).otherwise(total).alias("amount"),
            "lines",
            F.when(v == 4, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(day).alias("ocr_date"),
            F.when(v == 2, F.replace("c_name", F.lit("m"), F.lit("rn")))
            .otherwise(F.col("c_name"))
            .alias("ocr_customer"),
            F.when(v == 3, with_separator(total))
            .when(v == 5, F.floor(total).cast("string"))
            .otherwise(money(total))
            .alias("ocr_total"),
        )
        .withColumn(
            "ocr_supplier",
            F.when(v == 1, F.lit("")).otherwise(F.coalesce("supplier_name", F.lit(""))),
        )
    )
    nowhere = F.lit(None).cast("string")

    def party(name: str) -> Column:
        return F.when(
            F.col(name).isNotNull(),
            F.struct(F.col(name).alias("name"), nowhere.alias("address"), nowhere.alias("tax_id")),
        )

    printed = F.transform("lines", lambda line: _printed_line(v, line))
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("# INVOICE "), F.col("document_number")),
        F.concat(F.lit("Date: "), F.col("ocr_date")),
        F.col("ocr_supplier"),
        F.col("ocr_customer"),
    )
    body = F.concat_ws("\n", printed, F.concat(F.lit("TOTAL $"), F.col("ocr_total"), F.lit("\n")))
    return record.select(
        "doc_id", "v", "document_type", "document_number", "document_date",
        "supplier_name", "customer_name", "amount",
        party("supplier_name").alias("supplier"),
        party("customer_name").alias("customer"),
        F.struct(F.col("amount"), F.lit("USD").alias("currency")).alias("total_amount"),
        F.transform(
            "lines",
            lambda line: F.struct(
                line["p_name"].alias("description"),
                line["l_quantity"].alias("quantity"),
                line["p_retailprice"].alias("unit_price"),
                line["l_extendedprice"].alias("total"),
            ),
        ).alias("line_items"),
        "ocr_supplier", "ocr_customer",
        head.alias("ocr_head"),
        body.alias("ocr_body"),
        F.concat(head, F.lit("\n"), body).alias("ocr_text"),
    )


def bodies(docs: DataFrame) -> DataFrame:
    """Recorded extraction responses of the invoices: ``doc_id``, ``body`` and token columns.

    By ``doc_id % 12``: 0 and 11 good; 1 extra keys; 2 missing keys; 3 wrong types; 4 cut off; 5 no supplier;
    items that are 6 numbers, 7 null, 8 text; 9 a null type; 10 quantities that are words.
    """
    kind = F.pmod("doc_id", F.lit(12))

    def quoted(x: Column) -> Column:
        return F.when(x.isNull(), "null").otherwise(F.concat(F.lit('"'), x, F.lit('"')))

    def item(i: Column) -> Column:
        return F.concat(
            F.lit('{"description":"'), i["description"], F.lit('","quantity":'),
            F.when(kind == 10, '"many"').otherwise(money(i["quantity"])),
            F.when(kind == 2, "").otherwise(F.concat(F.lit(',"unit_price":'), money(i["unit_price"]))),
            F.lit(',"total":'), money(i["total"]),
            F.when(kind == 1, ',"sku":1}').otherwise("}"),
        )

    def party(x: Column) -> Column:
        named = F.concat(F.lit('{"name":'), quoted(x), F.lit(',"address":null,"tax_id":null}'))
        return F.when(x.isNull(), "null").otherwise(named)

    body = F.concat(
        F.when(kind == 1, '{"note":"x",').otherwise("{"),
        F.lit('"document_type":'), F.when(kind == 9, "null").otherwise('"invoice"'),
        F.lit(',"document_number":'), quoted(F.col("document_number")),
        F.when(kind == 2, "")
        .when(kind == 3, ',"document_date":20240101')
        .otherwise(F.concat(F.lit(',"document_date":'), quoted(F.col("document_date")))),
        F.lit(',"supplier":'), F.when(kind == 5, "null").otherwise(party(F.col("supplier_name"))),
        F.lit(',"customer":'), party(F.col("customer_name")),
        F.lit(',"total_amount":{"amount":'),
        F.when(kind == 3, '"n/a"').otherwise(money(F.col("amount"))),
        F.lit(',"currency":"USD"},"line_items":['),
        F.when(kind == 6, "1,2").when(kind == 7, "null").when(kind == 8, '"x"')
        .otherwise(F.array_join(F.transform("line_items", item), ",")),
        F.lit("]}"),
    )
    cut = F.when(kind == 4, F.left(body, F.length(body) - 5)).otherwise(body)
    return docs.select(
        "doc_id",
        cut.alias("body"),
        F.concat(F.lit("resp_"), F.col("doc_id").cast("string")).alias("response_id"),
        F.floor(F.length("ocr_text") / 4).cast("bigint").alias("input_tokens"),
        (F.pmod("doc_id", F.lit(200)) + 50).alias("output_tokens"),
    )


def receipts(docs: DataFrame) -> DataFrame:
    """The same invoices as receipts: ``doc_id``, ``body``."""
    names = F.transform("line_items", lambda i: F.concat(F.lit('"'), i["description"], F.lit('"')))
    body = F.concat(
        F.lit('{"store_name":"'), F.coalesce("supplier_name", F.lit("")),
        F.lit('","date":"'), F.coalesce("document_date", F.lit("")),
        F.lit('","items":['), F.array_join(names, ","),
        F.lit('],"subtotal":'), money(F.col("amount")), F.lit(',"tax":0.0,"total":'),
        money(F.col("amount")), F.lit(',"payment_method":null}'),
    )
    return docs.select("doc_id", body.alias("body"))


def payments(docs: DataFrame) -> DataFrame:
    """How invoices were paid: ``doc_id``, ``body``; a card, a transfer or cash by ``doc_id % 3``.

    By ``doc_id % 10``: 1 a way of no kind, 2 neither card nor transfer, 3 a word that isn't listed; 4 payer without a name;
    payee that is 5 a number, 6 has a key too many; amounts that are 7 text, 8 of text; 9 cut off.
    """
    kind, way = F.pmod("doc_id", F.lit(10)), F.pmod("doc_id", F.lit(3))
    number = F.col("document_number")
    method = (
        F.when(kind == 1, "5").when(kind == 2, '{"type":"card"}').when(kind == 3, '"cheque"')
        .when(way == 0, F.concat(F.lit('{"type":"card","number":"'), number, F.lit('"}')))
        .when(way == 1, F.concat(F.lit('{"type":"transfer","iban":"'), number, F.lit('"}')))
        .otherwise('"cash"')
    )
    payer = F.when(kind == 4, '{"tax_id":null}').otherwise(F.concat(F.lit('{"name":"'), F.col("customer_name"), F.lit('","tax_id":null}')))
    payee = (
        F.when(kind == 5, "7")
        .when(kind == 6, '{"name":"x","vat":1}')
        .otherwise(F.coalesce(F.concat(F.lit('{"name":"'), F.col("supplier_name"), F.lit('"}')), F.lit("null")))
    )
    amount = money(F.col("amount"))
    second = F.when(kind == 7, '"x"').when(kind == 8, '{"amount":"x","currency":"USD"}').otherwise(
        F.concat(F.lit('{"amount":'), amount, F.lit(',"currency":"USD"}'))
    )
    body = F.concat(
        F.lit('{"method":'), method, F.lit(',"payer":'), payer, F.lit(',"payee":'), payee,
        F.lit(',"amounts":['), amount, F.lit(","), second, F.lit("]}"),
    )
    return docs.select("doc_id", F.when(kind == 9, F.left(body, F.length(body) - 1)).otherwise(body).alias("body"))


def nested_lines(docs: DataFrame) -> DataFrame:
    """Invoices as chains: ``doc_id``, ``body`` with each line inside the one before it, and the total as a sum of sums.

    By ``doc_id % 6``, of the innermost: 1 a quantity that is text, 2 a line without description, 4 a sum that is text; 3 a key
    too many in every line; 5 cut off.
    """
    kind, many = F.pmod("doc_id", F.lit(6)), F.size("line_items")
    place = F.transform("line_items", lambda i, n: F.struct(i.alias("i"), n.alias("n")))

    def around(inner: Column, p: Column) -> Column:
        last = p["n"] == many - 1
        return F.concat(
            F.when(last & (kind == 2), "{").otherwise(F.concat(F.lit('{"description":"'), p["i"]["description"], F.lit('",'))),
            F.when(last & (kind == 1), '"quantity":"x"').otherwise(F.concat(F.lit('"quantity":'), money(p["i"]["quantity"]))),
            F.when(kind == 3, ',"sku":1').otherwise(""),
            F.lit(',"next":'), inner, F.lit("}"),
        )

    lines = F.aggregate(F.reverse(place), F.lit("null"), around)
    start = F.when(kind == 4, '"x"').otherwise("0")
    total = F.aggregate(
        "line_items", start, lambda s, i: F.concat(F.lit('{"left":'), s, F.lit(',"right":'), money(i["total"]), F.lit("}"))
    )
    body = F.concat(F.lit('{"lines":'), lines, F.lit(',"sum":'), total, F.lit("}"))
    return docs.select("doc_id", F.when(kind == 5, F.left(body, F.length(body) - 1)).otherwise(body).alias("body"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as files: ``page_id``, ``path``, ``size_bytes``, ``content``."""
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in (".pdf", ".PNG", ".jpg", ".jpeg", ".tar.gz", ".xyz", "", ".mp4", ".wav", ".py")]),
        F.pmod("page_id", F.lit(10)).cast("int") + 1,
    )
    content = F.encode("html", "UTF-8")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("in/v1.2/p"), F.col("page_id").cast("string"), suffix).alias("path"),
        F.octet_length("html").cast("bigint").alias("size_bytes"),
        content.alias("content"),
    )


def text_pairs(docs: DataFrame) -> DataFrame:
    """Pairs of texts from the same invoice: ``doc_id``, ``kind``, ``place``, ``a``, ``b``; of the items every neighbours."""
    names = F.col("line_items.description")

    def pair(kind: str, a: Column, b: Column, place: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), place.cast("int").alias("place"), a.alias("a"), b.alias("b"))

    neighbours = F.transform(
        F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))),
        lambda name, i: pair("items", name, F.get(names, i + 1), i + 1),
    )
    parties = F.array(
        pair("customer", F.col("customer_name"), F.col("ocr_customer"), F.lit(0)),
        pair("supplier", F.col("supplier_name"), F.col("ocr_supplier"), F.lit(0)),
    )
    return docs.select("doc_id", F.inline(F.concat(parties, neighbours)))


def judge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long judge table of the documents: scores from the labels, an error without a label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = docs.join(labels, "doc_id", "left")
    prompt = F.floor(F.col("n_chars") / 4).cast("bigint")

    def row(metric: str, score: Column, known: Column) -> Column:
        return F.struct(
            F.lit(metric).alias("metric"),
            F.when(known, score.cast("double")).alias("score"),
            F.when(~known, "no label").alias("error"),
            F.when(known, f"why {metric}").alias("reason"),
        )

    labelled = F.col("quality").isNotNull()
    return joined.select(
        "doc_id",
        prompt.alias("prompt_tokens"),
        (F.pmod("doc_id", F.lit(50)) + 10).alias("completion_tokens"),
        F.inline(
            F.array(
                row("groundedness", 1 + 4 * F.col("quality"), labelled),
                row("relevance", 5 - 4 * F.col("toxic"), labelled),
                row("coherence", 1 + F.pmod("doc_id", F.lit(5)), F.lit(True)),
            )
        ),
    ).withColumns(
        {
            "total_tokens": F.col("prompt_tokens") + F.col("completion_tokens"),
            "threshold": F.lit(3.0),
            "model": F.concat(F.lit("judge-"), F.col("metric")),
        }
    )


def mode_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extractions per document, one per mode; text mode records no mode name."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    tokens = F.floor(F.col("n_chars") / 4).cast("bigint")

    def run(mode: Column, extra: int, modulus: int) -> Column:
        return F.struct(
            mode.alias("mode"),
            (tokens + extra).alias("input_tokens"),
            (F.pmod("doc_id", F.lit(modulus)) / 100).alias("overall_confidence"),
        )

    return docs.select(
        "doc_id",
        F.concat(F.lit("model-"), F.col("lang")).alias("model"),
        (F.pmod("doc_id", F.lit(200)) + 50).alias("output_tokens"),
        F.inline(
            F.array(
                run(F.lit("hybrid_ocr_vision"), 1000, 101),
                run(F.lit(None).cast("string"), 0, 97),
            )
        ),
    )
