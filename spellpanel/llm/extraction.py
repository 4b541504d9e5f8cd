"""Main text of web pages by templates deduced from occurrence vectors of their host's pages."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spellpanel.llm.common import lookup
from spellpanel.llm.markup import NEARLY, article_print, is_container, own_container, preference, read_page, slot_text, weigh
from spellpanel.session import stage

#: Share of a host's pages that hold a class of tokens, and pages at least, for it to be template.
SUPPORT, MIN_PAGES = 0.5, 2
#: The same for text that is dropped as part of the template: a paragraph two pages share is none.
TEXT_SUPPORT, TEXT_PAGES = 0.8, 5
#: Share of a host's article text from which what its pages have in common is a copied article, not template.
COPIED = 0.5


def page_tokens(pages: DataFrame) -> DataFrame:
    """key, host, print (hash of the article text), chars of it, and one entry a token.

    Elements are told by path, texts by path and words: ``n`` occurrences, first ``place``, ``depth``,
    characters of article text in it (``mass``), kind (0 other element, 1 to 3 containers by
    preference, -1 text).
    """
    names = ("token", "n", "place", "depth", "mass", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in names}
            prints, chars = [], []
            for source in batch.column("html").to_pylist():
                page = read_page(source or "")
                weigh(page)
                times: Counter = Counter()
                seen: dict[int, list[int]] = {}
                for e in page.elements[1:]:
                    times[e.path] += 1
                    kind = 1 + preference(e.tag) if is_container(e) else 0
                    if e.path in seen:
                        seen[e.path][2] += e.mass
                    else:
                        seen[e.path] = [e.at, e.depth, e.mass, kind]
                for own, words, mark, _ in page.texts:
                    if mark:
                        e = page.elements[own]
                        times[mark] += 1
                        seen.setdefault(mark, [e.at, e.depth + 1, 0, -1])
                        seen[mark][2] += 0 if e.aside or e.link else len(words.strip())
                prints.append(article_print(page))
                chars.append(page.elements[0].mass)
                columns["token"].append(list(times))
                columns["n"].append(list(times.values()))
                for k, c in enumerate(names[2:]):
                    columns[c].append([seen[t][k] for t in times])
            yield pa.record_batch({
                "key": batch.column("key"), "host": batch.column("host"),
                "print": pa.array(prints, pa.int64()), "chars": pa.array(chars, pa.int64()),
                **{c: pa.array(v, pa.list_(pa.int64() if c in ("token", "mass") else pa.int32())) for c, v in columns.items()}})

    schema = "key long, host string, print long, chars long, token array<long>, n array<int>, place array<int>, depth array<int>, mass array<long>, kind array<int>"
    return pages.select("key", "host", "html").mapInArrow(run, schema)


def distinct_pages(tokens: DataFrame) -> DataFrame:
    """One page of each group of a host's pages with the same article text, so that copies are no evidence."""
    rest = [c for c in tokens.columns if c not in ("host", "print")]
    return tokens.groupBy("host", "print").agg(F.min(F.struct("key", *[c for c in rest if c != "key"])).alias("page")).select(
        "host", "page.*")


def host_templates(tokens: DataFrame) -> DataFrame:
    """host, pages, container (path of the main slot, null if none) and constant (hashes of template text).

    Tokens with the same occurrence vector over a host's pages, told by a sum of hashes of page and
    count, form an equivalence class.  A class is valid if it has several tokens, is on enough
    pages, and its tokens come in the same order on all of them.  Classes are not
    nested into one template; the one slot taken is the article or main element that holds nearly all text of the host's
    pages, the one with most text before the deepest; a host without one leaves the choice to each page.

    ``tokens`` has each article of a host once (``distinct_pages``).  Where the text in common is more
    than ``COPIED`` of the host's article text, the pages are near copies and none of it is template.
    """
    hosts = tokens.groupBy("host").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"))
    each = tokens.select("key", "host", F.explode(F.arrays_zip("token", "n", "place", "depth", "mass", "kind")).alias("t")).select(
        "key", "host", "t.*")
    vectors = each.groupBy("host", "token").agg(
        F.count("*").alias("held"), F.sum(F.xxhash64("key", "n").cast("decimal(20,0)")).alias("vector"),
        F.sum("mass").alias("mass"), F.max("kind").alias("kind"), F.max("depth").alias("depth"))
    frequent = lookup(vectors, hosts, "host", "pages").filter(
        (F.col("held") >= MIN_PAGES) & (F.col("held") >= SUPPORT * F.col("pages")))
    classes = frequent.groupBy("host", "held", "vector").agg(F.count("*").alias("size")).filter("size > 1")
    named = stage(frequent.join(classes, ["host", "held", "vector"]).withColumn(
        "class", F.xxhash64("host", "held", "vector")), "template-classes")
    # a token of a class and a page together: at most the template's tokens per page
    member = named.select(F.xxhash64("host", "token").alias("slot"), "class", "held")
    placed = lookup(each.select("key", "token", "place", F.xxhash64("host", "token").alias("slot")), member, "slot", "held")
    orders = placed.groupBy("class", "key").agg(
        F.xxhash64(F.transform(F.sort_array(F.collect_set(F.struct("place", "token"))), lambda x: x["token"])).alias("o"))
    valid = orders.groupBy("class").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).filter("lo = hi").select("class")
    template = named.join(valid, "class", "left_semi")
    most = F.max(F.when(F.col("kind") > 0, F.col("mass")))
    sized = template.join(template.groupBy("host").agg(most.alias("most")), "host")
    slot = F.max(F.when((F.col("kind") > 1) & (F.col("most") > 0) & (F.col("mass") >= NEARLY * F.col("most")),
                        F.struct("mass", "depth", "kind", "token")))
    shared = ((F.col("kind") == -1) & (F.col("held") >= TEXT_PAGES) & (F.col("held") >= TEXT_SUPPORT * F.col("pages")))
    fixed = F.when(F.coalesce(F.sum(F.when(shared, F.col("mass"))), F.lit(0)) <= COPIED * F.max("chars"),
                   F.collect_list(F.when(shared, F.col("token"))))
    return sized.groupBy("host").agg(F.max("pages").alias("pages"), slot["token"].alias("container"), fixed.alias("constant"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars, by_template.

    The template of the page's host (``host_templates``) names the container of the article and the
    text that belongs to the template.  Where it names none, or the page lacks it, the page's own smallest container
    with all of its article text is taken.  Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts
    and styles inside are left out by element and by names that consist of aside and layout words only
    (``site-header``, not ``article-header``; a header inside an article is part of it).  Character references are decoded, white space in a block becomes one blank, blocks
    are joined by an empty line.

    Null or empty html gives an empty text.  A null url is a host of its own.  Repeated rows are pages
    each in the result; the template is judged on pages with different article text, and a host with fewer than
    two of those has none.  An empty table gives no rows.  Other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
                        host.alias("host")).withColumn("key", F.xxhash64("page_id", "url", F.crc32(F.col("html").cast("binary"))))
    tokens = stage(distinct_pages(page_tokens(rows)), "page-tokens")
    templates = stage(host_templates(tokens), "host-templates")
    kind = dict(pages.select("page_id").dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, used = [], []
            for source, container, constant in zip(*(batch.column(c).to_pylist() for c in ("html", "container", "constant")),
                                                   strict=True):
                page = read_page(source or "")
                fixed = set(constant or ())
                known = container is not None and any(e.path == container for e in page.elements)
                if not known:
                    weigh(page, fixed)
                    container = own_container(page)
                texts.append(slot_text(page, container, fixed))
                used.append(known or bool(fixed))
            yield pa.record_batch({
                "page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()), "by_template": pa.array(used, pa.bool_())})

    joined = lookup(rows.select("page_id", "url", "html", "host"), templates, "host", "pages", "left")
    return joined.select("page_id", "url", "html", "container", "constant").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long, by_template boolean")
