"""Model prompts and replies as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnslake import refdata
from dnslake.operators.windows import number_batches


def category_of(raw: Column) -> Column:
    """Category a model's word stands for; null when there is none."""
    word = F.lower(F.regexp_replace(raw, r"""^[\s"']+|[\s"']+$""", ""))
    word = F.regexp_replace(word, r"[ _-]", "")
    flat = [F.lit(x) for kv in refdata.CATEGORY_SYNONYMS.items() for x in kv]
    named = F.coalesce(F.try_element_at(F.create_map(*flat), word), word)
    return F.when(named.isin(list(refdata.CATEGORIES)), named)


def confidence_of(raw: Column) -> Column:
    """``85%``, ``85``, ``0.85`` or a word to 0..1; 0 when unreadable."""
    word = F.lower(F.regexp_replace(raw, r"""^[\s"']+|[\s"']+$""", ""))
    percent = F.when(word.endswith("%"), F.regexp_replace(word, r"\s*%$", "").try_cast("double"))
    number = word.try_cast("double")
    flat = [F.lit(x) for kv in refdata.CONFIDENCE_WORDS.items() for x in kv]
    value = F.coalesce(percent / 100, F.when(number > 1, number / 100).otherwise(number),
                       F.try_element_at(F.create_map(*flat), word), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def evidence_line(df: DataFrame) -> DataFrame:
    """``(name, line, query_count)``: a list item with the name and what is known of it.

    Input is a candidate row of the scorer; what is unknown is left out.
    """
    def known(value: Column, text: str) -> Column:
        return F.when(value.isNotNull() & (value.cast("string") != "") & (value.cast("string") != "0"),
                      F.format_string(text, value.cast("string")))

    chain = F.col("dns.cname_chain")
    # slice, not element_at: an empty array must not fail under ANSI rules.
    target = F.get(F.slice(chain, -1, 1), F.lit(0))
    age = F.when(F.col("rdap.age_days") < 180, F.col("rdap.age_days"))
    hits = F.when(F.col("vt.known"), F.col("vt.malicious"))
    empty = F.col("http").isNotNull() & (
        F.coalesce("http.is_pixel", F.lit(False)) | (F.coalesce("http.text_len", F.lit(0)) < 200))
    heading = F.trim(F.regexp_replace("http.title", r"[\s,:]+", " "))
    facts = [
        known(F.col("query_count"), "%s queries"), known(F.col("client_count"), "%s clients"),
        F.when(F.col("in_list"), "on a blocklist"),
        F.when(~F.col("in_list") & F.col("etld1_in_list"), "parent name on a blocklist"),
        known(hits, "%s malware engines report it"), known(age, "registered %s days ago"),
        known(F.col("rank.tranco"), "popularity rank %s"), known(target, "alias of %s"),
        known(F.col("asn.org"), "hosted by %s"), known(F.col("http.parking"), "parking page of %s"),
        F.when(empty, "page without text"), known(heading, "page title %s"),
    ]
    text = F.concat_ws(": ", F.concat(F.lit("- "), F.col("name")),
                       F.nullif(F.concat_ws(", ", *facts), F.lit("")))
    return df.select("name", text.alias("line"), "query_count")


def build_prompts(lines: DataFrame, size: int = 40, limit: int | None = None) -> DataFrame:
    """``(batch, n, prompt)``: names by number of queries, ``size`` to a prompt."""
    numbered = number_batches(lines, [F.desc("query_count"), F.asc("name")], size, limit)
    packed = F.array_sort(F.collect_list(F.struct("position", "line")))  # ``size`` rows at most
    body = F.array_join(F.transform(packed, lambda r: r["line"]), "\n")
    head = F.format_string("One CSV line (domain,category,confidence,reason) for each of these names, "
                           "%d in all:\n", F.col("n"))
    return (numbered.groupBy("batch").agg(F.count("*").alias("n"), body.alias("_body"))
            .select("batch", "n", F.concat(head, F.col("_body")).alias("prompt")))


def reply_lines(replies: DataFrame) -> DataFrame:
    """Lines of ``replies (reply_id, reply)``; inside code fences only, where there are any."""
    lines = F.split(F.regexp_replace("reply", r"^\s+|\s+$", ""), r"\r?\n")
    rows = replies.select("reply_id", F.col("reply").contains("```").alias("_fenced"),
                          F.posexplode(lines).alias("line_no", "_line"))
    fence = F.ltrim("_line").startswith("```")
    # Fence lines so far, in one pass over a reply: odd means inside.
    so_far = F.count_if(fence).over(Window.partitionBy("reply_id").orderBy("line_no"))
    inside = ~F.col("_fenced") | (~fence & (F.col("_fences") % 2 == 1))
    return (rows.withColumn("_fences", so_far).where(inside & (F.trim("_line") != ""))
            .select("reply_id", "line_no", F.ltrim("_line").alias("line")))


def _fields(line: Column) -> Column:
    """Comma-separated fields of a line.

    A field that begins with a quote runs to a quote before a comma or the end; quotes elsewhere
    are plain.  If that leaves a field open, the line is cut at every comma.  The line is cut
    once and its pieces are joined in one walk, so neither quotes nor commas multiply the work.
    """
    pieces = F.split(line, ",")

    def quotes_at_end(s: Column) -> Column:
        return F.length(s) - F.length(F.rtrim(s, F.lit('"')))

    def step(acc: Column, piece: Column) -> Column:
        text = F.trim(piece)
        starts = ~acc["open"] & text.startswith('"')
        tail = F.when(starts, F.substring(text, 2, 1 << 30)).otherwise(text)
        open_ = (acc["open"] | starts) & (quotes_at_end(tail) % 2 == 0)
        merged = F.concat(F.slice(acc["fields"], F.lit(1), F.size(acc["fields"]) - 1), F.array(
            F.concat(F.get(acc["fields"], F.size(acc["fields"]) - 1), F.lit(","), piece)))
        fields = F.when(acc["open"], merged).otherwise(F.concat(acc["fields"], F.array(F.ltrim(piece))))
        return F.struct(open_.alias("open"), fields.alias("fields"))

    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("fields"))
    walked = F.aggregate(pieces, start, step)
    cut = F.when(walked["open"], F.transform(pieces, lambda p: F.ltrim(p))).otherwise(walked["fields"])
    return F.transform(cut, lambda f: F.when(
        f.startswith('"') & F.rtrim(f).endswith('"') & (F.length(F.rtrim(f)) > 1),
        F.replace(F.substring(F.rtrim(f), F.lit(2), F.length(F.rtrim(f)) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def parse_replies(replies: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model replies to ``(verdicts, counts per reply)``.

    ``asked (reply_id, domain)``.  A line needs three fields, a name that was asked for and a
    known category; the first verdict on a name wins.  Others count as skipped, strange names as
    unknown; heading lines count as nothing.
    """
    f = _fields(F.col("line"))
    rows = reply_lines(replies).withColumn("_f", f).select(
        "reply_id", "line_no", F.size("_f").alias("_n"),
        F.lower(F.regexp_replace(F.get("_f", F.lit(0)), r"""^[\s"']+|[\s"']+$""", "")).alias("key"),
        category_of(F.get("_f", F.lit(1))).alias("category"),
        confidence_of(F.coalesce(F.get("_f", F.lit(2)), F.lit(""))).alias("confidence"),
        F.regexp_replace(F.array_join(F.slice("_f", 4, F.greatest(F.size("_f"), F.lit(1))), ", "),
                         r"""^["']+|["']+$""", "").alias("reason"))
    wanted = asked.select("reply_id", F.lower(F.trim("domain")).alias("key"),
                          F.col("domain").alias("_domain")).dropDuplicates(["reply_id", "key"])
    rows = rows.join(wanted, ["reply_id", "key"], "left")
    heading = (F.col("_n") >= 3) & F.col("key").isin("", "domain")
    short = F.col("_n") < 3
    unknown = ~short & ~heading & F.col("_domain").isNull()
    good = ~short & ~heading & F.col("_domain").isNotNull() & F.col("category").isNotNull()
    rows = rows.withColumn("_class", F.when(short, "short").when(heading, "heading")
                           .when(unknown, "unknown").when(good, "good").otherwise("category"))
    verdicts = (rows.where(F.col("_class") == "good").groupBy("reply_id", "_domain").agg(
        F.min_by(F.struct("category", "confidence", "reason"), "line_no").alias("_v"))
        .select("reply_id", F.col("_domain").alias("domain"), "_v.*"))
    tally = rows.groupBy("reply_id").agg(
        F.count_if(F.col("_class") != "heading").alias("_lines"),
        F.count_if(F.col("_class") == "unknown").alias("unknown"))
    parsed = verdicts.groupBy("reply_id").agg(F.count("*").alias("parsed"))
    counts = (tally.join(parsed, "reply_id", "left")
              .withColumn("parsed", F.coalesce("parsed", F.lit(0)))
              .select("reply_id", "parsed", (F.col("_lines") - F.col("parsed")).alias("skipped"),
                      "unknown"))
    return verdicts, counts
