"""HTML extraction by equivalence classes: the template that pages of one host share is deduced, and what stands in its slots is kept.

A token is a tag at its place (the path of containers with their classes) or a whole text at its place. Tokens that occur equally often
on every page of a host share an occurrence vector and make an equivalence class. A vector is kept as the exclusive or of one 64-bit
hash for each (page, number of occurrences), beside the number of pages, so it is aggregated before it is shuffled and a host of any
share of the pages is no single group. A class on enough pages is large and frequent; it is valid if its tokens come in one order on all
its pages, over and over, and if it lies in one slot of the class around it. Valid classes, nested, are the host's template: its texts
are boilerplate, and all other texts are slots.

Slots are read in page order. Those of menus, headers, footers, sidebars, notices, adverts, forms, hidden parts and reader comments go,
by elements and by the words of class, id and role. Of the rest, those of article elements are the main text; where a page has none with
text, those of main elements; where it has neither, all that aren't links only. Texts inside an article or main element are no tokens:
copies of one article on many pages of a host are no template.

Defined results: null html is empty, null urls are one host; pages of hosts with fewer than LEAST pages have no template and go by their
elements alone; a comment, script or style without an end runs to the end of the page, a tag cut off there is dropped, a quote without an
end closes with its tag; repeated rows come out each; texts of any length are read whole, in time linear in them; nothing is extracted
twice, so ties don't arise; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_parts, sliced, split_join

#: A template needs so many pages of a host, and its classes this share of them.
LEAST = 3
SHARE = 0.5
#: Templates of so many tokens together may be sent to every executor; larger ones are joined by a shuffle.
MOST_BROADCAST = 200_000

# HTML's own names, and words that sites use for what isn't the article.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
NEVER = set("aside audio button canvas datalist dialog footer form head iframe input menu nav noscript object search select svg template textarea title video".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
MARKS = set("ad ads adslot advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "reply", "respond"}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTED = re.compile(r"""[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z]+")


def hashed(seed: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed & (2**64 - 1)) - 2**63


def parts(html: str):
    """Tags and texts in order: (name, attributes) of a start tag, (/name, '') of an end tag, ('', text) of text."""
    at, size, unquoted = 0, len(html), False
    while at < size:
        start = html.find("<", at)
        if start != at:
            start = size if start < 0 else start
            yield "", html[at:start]
            at = start
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 2)
            at = size if end < 0 else end + 3
            continue
        closing = html.startswith("/", at + 1)
        name = _NAME.match(html, at + 1 + closing)
        if name is None:
            if closing or html.startswith(("!", "?"), at + 1):
                end = html.find(">", at)
                at = size if end < 0 else end + 1
            else:
                yield "", "<"
                at += 1
            continue
        end = html.find(">", name.end())
        if end < 0:
            return
        inside = html[name.end() : end]
        if not unquoted and (inside.count('"') % 2 or inside.count("'") % 2):
            whole = _QUOTED.match(html, name.end())
            if whole:
                end = whole.end() - 1
                inside = html[name.end() : end]
            else:
                unquoted = True
        tag, at = name.group().lower(), end + 1
        yield ("/" + tag, "") if closing else (tag, inside)
        if not closing and tag in RAW:
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = found.start() if found else size


class Page:
    """A page's tokens, by place, and its blocks (text, token, in an article, in main, links only) that no element rules out."""

    def __init__(self, html: str):
        self.tokens: list[int] = []
        self.blocks: list[tuple[str, int, bool, bool, bool]] = []
        # name, path, out by an element, out by a mark, in comments, in an article, in main, the text around an inline element
        stack = [("", 0, False, False, False, False, False, None)]
        open_tags: Counter = Counter()
        held: list[str] = []
        linked = plain = False
        in_link = 0

        def flush() -> None:
            nonlocal linked, plain
            text = " ".join("".join(held).split())
            if text:
                _, path, never, marked, comment, article, main, _ = stack[-1]
                token = 0
                if not (article or main):
                    token = hashed(path, "=" + text)
                    self.tokens.append(token)
                if not (never or marked or comment):
                    self.blocks.append((text, token, article, main, linked and not plain))
            held.clear()
            linked = plain = False

        def pop() -> None:
            nonlocal held, linked, plain
            flush()
            name, *_, around = stack.pop()
            open_tags[name] -= 1
            if around is not None:
                held, linked, plain = around

        for name, rest in parts(html):
            if not name:
                held.append(unescape(rest))
                if not rest.isspace():
                    linked, plain = linked or in_link > 0, plain or in_link == 0
            elif name == "br":
                held.append(" ")
            elif name == "a" or name == "/a":
                in_link = int(name == "a")
            elif name[0] == "/":
                if open_tags[name[1:]]:
                    while stack[-1][0] != name[1:]:
                        pop()
                    pop()
                elif name[1:] in BLOCKS:
                    flush()
            else:
                marks, hidden, label, role = set(), False, "", ""
                if rest and name not in VOID:
                    for key, *values in _ATTRIBUTE.findall(rest):
                        key, value = key.lower(), "".join(values).lower()
                        if key in ("class", "id", "role"):
                            marks |= set(_WORD.findall(value))
                            label += f".{value}" if key == "class" else ""
                            role = value if key == "role" else role
                        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
                            hidden = True
                block = name in BLOCKS
                if block:
                    flush()
                    if stack[-1][0] == "p" or stack[-1][0] in CLOSES.get(name, ()):
                        pop()
                    while stack[-1][0] in CLOSES.get(name, ()):
                        pop()
                if name in VOID:
                    continue
                whole = name in ("html", "body", "article", "main")
                mark = not whole and not marks.isdisjoint(MARKS)
                if not (block or mark or hidden or name in NEVER or name in RAW):
                    continue
                _, path, never, marked, comment, article, main, _ = stack[-1]
                path = hashed(path, name + label)
                if not (article or main):
                    self.tokens.append(path)
                comment = comment or (name not in ("html", "body") and not marks.isdisjoint(COMMENTS))
                never = never or hidden or name in NEVER or name in RAW or (name == "header" and not (article or main))
                marked = (marked or mark) and name not in ("article", "main")
                if "header" in marks and (article or main):
                    marked = stack[-1][3] or not marks.isdisjoint(MARKS - {"header"})
                around = None
                if not block:
                    # a block goes on behind what is left out of it
                    around, held, linked, plain = (held, linked, plain), [], False, False
                stack.append((name, path, never, marked, comment, article or name == "article", main or name == "main" or role == "main", around))
                open_tags[name] += 1
        flush()

    def text(self, template: set[int]) -> str:
        slots = [b for b in self.blocks if b[1] not in template]
        chosen = [b for b in slots if b[2]] or [b for b in slots if b[3]] or [b for b in slots if not b[4]]
        return "\n\n".join(b[0] for b in chosen)


def token_rows(batches):
    """(host, token, vector) for every token of every page."""
    for batch in (b for all_batches in batches for b in sliced([all_batches], 2)):
        hosts, tokens, vectors = [], [], []
        for host, key, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
            # token 0 stands for the page, so that pages without any token count too
            for token, n in (Counter(Page(html or "").tokens) | Counter({0: 1})).items():
                hosts.append(host)
                tokens.append(token)
                vectors.append(hashed(key, str(n)))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(tokens, pa.int64()), pa.array(vectors, pa.int64())], ["host", "token", "vector"])


def roles(tokens: list[int], class_of: dict[int, int]):
    """For each class on a page: (class, whether its tokens repeat in one order without crossing another, that order, the slot around it)."""
    order: dict[int, list[int]] = {}
    came = [(class_of[t], t) for t in tokens if t in class_of]
    for c, t in came:
        order.setdefault(c, []).append(t)
    sizes, good = {c: len(set(ts)) for c, ts in order.items()}, {}
    for c, ts in order.items():
        good[c] = len(ts) % sizes[c] == 0 and all(t == ts[i % sizes[c]] for i, t in enumerate(ts)) and len(set(ts[: sizes[c]])) == sizes[c]
    seen, inside, around = Counter(), [], {}
    for c, _ in came:
        if not good[c]:
            continue
        k = seen[c] % sizes[c]
        seen[c] += 1
        if k == 0:
            slot = hashed(inside[-1][0], str(inside[-1][1])) if inside else 0
            good[c] = around.setdefault(c, slot) == slot
            inside.append([c, 0])
        else:
            while inside and inside[-1][0] != c:
                good[inside.pop()[0]] = False
        if inside and inside[-1][0] == c:
            inside[-1][1] = k
            if k == sizes[c] - 1:
                inside.pop()
    return [(c, good[c], hashed(0, ",".join(map(str, ts[: sizes[c]]))), around.get(c, 0)) for c, ts in order.items()]


def role_rows(batches):
    for batch in (b for all_batches in batches for b in sliced([all_batches], 2)):
        found = []
        for host, _, html, tokens, classes in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if tokens:
                found += [(host, *r) for r in roles(Page(html or "").tokens, dict(zip(tokens, classes)))]
        hosts, classes, good, order, slot = zip(*found) if found else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(classes, pa.int64()), pa.array(good, pa.bool_()), pa.array(order, pa.int64()), pa.array(slot, pa.int64())], ["host", "class", "good", "sequence", "slot"]
        )


def text_rows(batches):
    for batch in (b for all_batches in batches for b in sliced([all_batches], 2)):
        texts = [Page(html or "").text(set(tokens or ())) for html, tokens in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def beside(pages: DataFrame, templates: DataFrame, scratch: Scratch, counts: DataFrame) -> DataFrame:
    """Pages with their host's row of templates (host, tokens, ...), if there is one."""
    if (templates.agg(F.sum(F.size("tokens"))).first()[0] or 0) <= MOST_BROADCAST:
        return pages.join(F.broadcast(templates), "host", "left")
    return split_join(pages, templates, ["host"], hot_parts(counts, ["host"]), "left")


def deduce(pages: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(host, tokens) of each host's template, and (host, n) of its pages; pages are (host, key, html)."""
    rows = pages.mapInArrow(token_rows, "host string, token long, vector long")
    seen = scratch.table(rows.groupBy("host", "token").agg(F.count("*").alias("n"), F.bit_xor("vector").alias("vector")), "tokens")
    counts = scratch.table(seen.where("token = 0").select("host", "n"), "hosts")
    enough = F.col("n") >= F.greatest(F.lit(float(LEAST)), F.col("pages") * SHARE)
    frequent = seen.where("token <> 0").join(counts.withColumnRenamed("n", "pages"), "host").where(enough).select("host", "token", F.xxhash64("vector", "n").alias("class"))
    frequent = scratch.table(frequent, "classes")
    listed = frequent.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("x")).select("host", F.col("x.token").alias("tokens"), F.col("x.class").alias("classes"))
    placed = beside(pages, listed, scratch, counts).select("host", "key", "html", "tokens", "classes").mapInArrow(role_rows, "host string, class long, good boolean, sequence long, slot long")
    valid = placed.groupBy("host", "class").agg(F.min("good").alias("good"), (F.min("sequence") == F.max("sequence")).alias("ordered"), (F.min("slot") == F.max("slot")).alias("nested"))
    template = frequent.join(valid.where("good AND ordered AND nested"), ["host", "class"]).groupBy("host").agg(F.collect_list("token").alias("tokens"))
    return scratch.table(template, "template"), counts


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    scratch = Scratch(pages.sparkSession, "templates")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host")
    pages = pages.select(host, F.xxhash64("page_id", "url").alias("key"), "html", "page_id", "url")
    template, counts = deduce(pages.select("host", "key", "html"), scratch)
    found = beside(pages, template, scratch, counts).select("page_id", "url", "html", "tokens")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.select("page_id", "url").schema.fields)
    return found.mapInArrow(text_rows, f"{kinds}, text string").withColumn("n_chars", F.length("text").cast("long"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
