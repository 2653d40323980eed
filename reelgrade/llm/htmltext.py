"""Main text of web pages by consensus of each host's pages on the containers that hold it."""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace
from .urlfilter import url_host

# Elements of HTML, and the words by which sites name what isn't the article.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("body main article section div td center".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math canvas xmp noembed noframes object video audio".split())
APART = frozenset("head nav header footer aside form button select option label dialog menu noscript".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
APART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside header masthead footer cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup "
    "login register comment comments respond replies reply disqus share sharing social related recommended pagination pager search toolbar "
    "copyright widget skip hidden".split()
)
#: Parts of names that say what a wrapper has or lacks, and elements that no name sets apart.
COMPOUND = frozenset("has have is no not with without".split())
NEVER_NAMED = frozenset("html body main article".split())
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S
)
RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A container stands for its page if it holds this share of what its parent holds, and the parent has less than OWN of the
#: page's text in itself; other containers with OWN of the page's text stand for it too.
SHARE, OWN = 0.7, 0.1
#: An element set apart by its name alone stays in the page if it holds more than this share of the page's text.
MOST = 0.5
#: A path wins if this share of its host's pages vote for it (so that a host's winners are bounded by its pages' votes), and
#: serves a page of which it holds the share USED.
WINS, USED = 0.05, 0.5
#: A container whose text is the same on so many pages or more of its host is no article, if others differ.
SAME = 3
#: Characters of a path beyond which a hash stands for what is above its last element.
LONG_PATH = 400
#: Hosts up to which the winning paths (some 100 bytes each) are sent to every task; beyond that they are joined.
SENT_HOSTS = 50_000


class Page:
    """The blocks of a page outside menus, notices and the like, and the containers that hold them."""

    __slots__ = ("paths", "parents", "blocks", "regions", "_named")

    def __init__(self, source: str):
        self.paths: list[str] = ["body"]
        self.parents: list[int] = [-1]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters of it in links
        self.regions: list[int] = [-1]  # elements set apart by name alone, each with the one around it; 0 is the page
        self._named: list[int] = []  # the region of each block
        self._read(source)
        self._set_apart()

    def _set_apart(self) -> None:
        """Drop the blocks in regions that are apart, unless those hold most of the page's text, or all of it."""
        held = [0.0] * len(self.regions)
        for (_, text, linked), region in zip(self.blocks, self._named, strict=True):
            held[region] += max(0, len(text) - 2 * linked)
        for i in range(len(held) - 1, 0, -1):
            held[self.regions[i]] += held[i]
        gone = [False]
        for i in range(1, len(held)):
            gone.append(gone[self.regions[i]] or held[i] <= MOST * held[0])
        kept = [b for b, region in zip(self.blocks, self._named, strict=True) if not gone[region]]
        self.blocks = kept or self.blocks

    def _read(self, source: str) -> None:
        held, linked = [], 0  # text of the open block, and how much of it is in links
        stack: list[tuple[str, int, bool, bool, int]] = []  # tag, and what holds inside it: container, apart, link, region
        inside, apart, link, region = 0, False, False, 0
        at = 0

        def close() -> None:
            nonlocal held, linked
            if held:
                if text := " ".join("".join(held).split()):
                    self.blocks.append((inside, text, min(linked, len(text))))
                    self._named.append(region)
                held, linked = [], 0

        def leave(k: int) -> None:
            nonlocal inside, apart, link, region
            close()
            del stack[k:]
            _, inside, apart, link, region = stack[-1] if stack else ("", 0, False, False, 0)

        def put(text: str) -> None:
            nonlocal linked
            if text and not apart:
                text = entities.unescape(text) if "&" in text else text
                held.append(text)
                if link:
                    linked += len(text)

        while at < len(source):
            m = TAG.search(source, at)
            if m is None:
                put(source[at:])
                break
            put(source[at : m.start()])
            at = m.end()
            ending, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if ending:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        if name in BLOCKS or name in APART:
                            leave(k)
                        else:
                            if k == len(stack) - 1:
                                _, _, apart_, _, region_ = stack[k - 1] if k else ("", 0, False, False, 0)
                                if (apart_, region_) != (apart, region):
                                    close()
                                apart, region = apart_, region_
                            del stack[k]
                            link = any(e[0] == "a" for e in stack)
                        break
                else:
                    if name in BLOCKS:
                        close()
                continue
            if name in RAW:
                ends = RAW_END[name].search(source, at)
                if ends is None:
                    at = len(source) if name in ("script", "style") else at
                else:
                    end = source.find(">", ends.start())
                    at = len(source) if end < 0 else end + 1
                continue
            if name in VOID:
                if name == "br":
                    put(" ")
                elif name == "hr":
                    close()
                continue
            if name == "body":
                leave(0)
            elif name in BLOCKS:
                close()
                for k in range(len(stack) - 1, -1, -1):  # an open paragraph ends here, an item at the next item
                    open_ = stack[k][0]
                    if open_ == "p" or (open_ == name and name in ("li", "dt", "dd", "td", "th", "tr", "option")):
                        leave(k)
                        break
                    if open_ in CONTAINERS or open_ in ("ul", "ol", "table", "blockquote"):
                        break
            names, hidden, named = "", False, False
            if rest and rest.strip(" /"):
                names, hidden, named = self._attributes(rest)
            apart = apart or name in APART or hidden
            if apart and name in HEADINGS and not hidden and self._of_article(stack):
                apart = False
            if name in CONTAINERS and name != "body" and not apart:
                path = f"{self.paths[inside]}/{name}{names}"
                self.paths.append(path if len(path) <= LONG_PATH else f"{hashlib.blake2b(path.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}/{name}")
                self.parents.append(inside)
                inside = len(self.paths) - 1
            link = link or name == "a"
            if named and not apart and name not in NEVER_NAMED and (not rest.endswith("/") or name in BLOCKS):
                if name not in BLOCKS:
                    close()
                self.regions.append(region)
                region = len(self.regions) - 1
            if not rest.endswith("/") or name in BLOCKS:
                stack.append((name, inside, apart, link, region))
        close()

    @staticmethod
    def _of_article(stack: list[tuple[str, int, bool, bool, int]]) -> bool:
        """Whether a heading here is in the header of an article, and in nothing else that is apart."""
        tags = [e[0] for e in stack]
        if "header" not in tags:
            return False
        k = len(tags) - 1 - tags[::-1].index("header")
        return not stack[k - 1][2] and not APART.intersection(tags[k + 1 :]) and ("article" in tags[:k] or "main" in tags[:k]) if k else False

    @staticmethod
    def _attributes(rest: str) -> tuple[str, bool, bool]:
        """The classes as part of a path, digits as #; whether the element is hidden or has such a role; whether its name sets it apart."""
        classes, hidden, named = [], False, False
        for m in ATTRIBUTE.finditer(rest):
            if m[5]:
                hidden = True
                continue
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                words = value.lower().split()
                parts = [re.split(r"[-_:]+", w) for w in words]
                named = named or any(not APART_NAMES.isdisjoint(x) and COMPOUND.isdisjoint(x) for x in parts)
                if key == "class":
                    classes += words
            elif key == "role" and value.lower() in APART_ROLES or key == "aria-hidden" and value == "true":
                hidden = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
        return "".join(f".{c}" for c in sorted({re.sub(r"\d+", "#", c) for c in classes})), hidden, named

    def scores(self) -> list[float]:
        """For each container: the text that it holds, less what is in links."""
        found = [0.0] * len(self.paths)
        for inside, text, linked in self.blocks:
            found[inside] += max(0, len(text) - 2 * linked)
        for i in range(len(found) - 1, 0, -1):
            found[self.parents[i]] += found[i]
        return found

    def chosen(self) -> list[int]:
        """The containers that stand for the page, by themselves: its main element or its articles, if they hold text; in
        what is left, the deepest container that still holds most of the text, and others that hold OWN of it."""
        found = self.scores()
        total = found[0]
        if total <= 0:
            return [0]
        last = [p.rsplit("/", 1)[-1].split(".", 1)[0] for p in self.paths]
        tops = [i for i, t in enumerate(last) if t == "main" and found[i] > 0][:1]
        if not tops:
            articles = {i for i, t in enumerate(last) if t == "article" and found[i] > 0}
            tops = [i for i in sorted(articles) if not articles.intersection(self._above(i))]
        children: dict[int, list[int]] = {}
        for i in range(1, len(found)):
            children.setdefault(self.parents[i], []).append(i)
        at, others = (tops[0], tops[1:]) if tops else (0, [])
        while children.get(at) and found[at] > 0:
            below = max(children[at], key=lambda i: found[i])
            own = found[at] - sum(found[i] for i in children[at])
            if found[below] < SHARE * found[at] or own >= OWN * total:
                break
            others += [i for i in children[at] if i != below and found[i] >= OWN * total]
            at = below
        return [at, *others]

    def _above(self, i: int) -> list[int]:
        out = []
        while (i := self.parents[i]) >= 0:
            out.append(i)
        return out

    def best(self) -> tuple[str, float]:
        """The path of the container that stands for the page first, and what it holds."""
        at = self.chosen()[0]
        return self.paths[at], self.scores()[at]

    def votes(self) -> list[tuple[str, float, int]]:
        """For each path that stands for the page: what it holds, and a checksum of its text."""
        found, out = self.scores(), {}
        for path in dict.fromkeys(self.paths[i] for i in self.chosen()):
            held, total = self._held([path], found)
            out[path] = total, zlib.crc32("\n".join(t for i, t, _ in self.blocks if held[i]).encode("utf-8", "surrogatepass"))
        return [(p, n, c) for p, (n, c) in out.items() if n > 0]

    def _held(self, paths: list[str], found: list[float]) -> tuple[list[bool], float]:
        """Which containers stand under one of the paths, and what these hold."""
        held, total = [], 0.0
        for i, p in enumerate(self.paths):
            above = self.parents[i] >= 0 and held[self.parents[i]]
            held.append(above or p in paths)
            if held[i] and not above:
                total += found[i]
        return held, total

    def text(self, winning: list[str], barred: list[str] | tuple = ()) -> str:
        """The blocks under the winning paths, if these hold enough of the page but for what is barred; else under those that
        stand for the page by themselves, if any isn't barred; else all."""
        found = self.scores()
        own = [self.paths[i] for i in self.chosen()]
        for paths, least in ((winning, USED * (found[0] - self._held(list(barred), found)[1])), ([p for p in own if p not in barred], 0.0)):
            held, total = self._held(paths, found)
            if any(held) and total >= least and total > 0:
                return "\n".join(text for inside, text, _ in self.blocks if held[inside])
        return "\n".join(text for _, text, _ in self.blocks)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row without a path for each page, and one for each of its votes."""
    kinds = (pa.string(), pa.string(), pa.float64(), pa.int64())
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part, rows = batch.slice(i, 500), []
            for host, source in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                found = Page(source.as_py() or "").votes()
                if found:
                    rows.append((host, None, 0.0, 0))
                    rows += [(host, *v) for v in found]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "path", "score", "mark"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            given = zip(part.column(2), part.column(3), part.column(4), strict=True)
            found = [Page(h.as_py() or "").text(w.as_py() or [], b.as_py() or []) for h, w, b in given]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(found, pa.string())], names=["id", "url", "text"])


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, its winning paths (most votes first, then the larger text, then the smaller path), and those that are barred.

    A page votes for each path that stands for it. A path whose text is the same on SAME pages or more, on all that vote
    for it, is barred if another path's text differs from page to page.
    """
    votes = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    votes = votes.mapInArrow(_votes, "host string, path string, score double, mark long")
    sums = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("size"), F.min("mark").alias("lo"), F.max("mark").alias("hi"))
    whole = sums.groupBy("host").agg(
        F.max(F.when(F.col("path").isNull(), F.col("n"))).alias("pages"), F.max(F.when(F.col("path").isNotNull(), F.col("lo") != F.col("hi"))).alias("differs")
    )
    sums = sums.where("path IS NOT NULL").join(whole.hint("merge"), "host")
    barred = F.col("differs") & (F.col("lo") == F.col("hi")) & (F.col("n") >= SAME)
    told = sums.withColumn("barred", barred).where(F.col("n") >= WINS * F.col("pages"))
    place = F.struct((-F.col("n")).alias("n"), (-F.col("size")).alias("size"), "path")
    ordered = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, place))), lambda x: x["path"])
    return told.groupBy("host").agg(ordered(~F.col("barred")).alias("paths"), ordered(F.col("barred")).alias("barred"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (blocks joined by newlines, empty if none) and n_chars.

    Every page scores its containers and votes for the paths (tags and classes, digits generalised) of those that stand
    for it: its main element or articles where it has them, else the one that holds most of its text, and others that
    hold a share of it. Votes are summed by host, paths whose text is the same from page to page are barred where others
    differ, and each page is read again with its host's winning paths. A page of which they hold less than half uses its
    own choice. Menus, notices and the like are known by element, role and words of class or id; no name sets body, main
    or article apart, nor a part that holds most of the page. Of an article's own header, its headings stay.

    A null or empty html has an empty text; a null url, or one without ``://``, belongs to the host without a name. Null
    and repeated ids come back as they are; other columns are not read. Unclosed and stray tags, quotes and comments are
    read as browsers do, roughly. No rows: no rows.
    """
    space = Workspace(pages.sparkSession, "html")
    winners = space.table(host_paths(pages, url_col, html_col), "paths")
    winners = F.broadcast(winners) if winners.count() <= SENT_HOSTS else winners
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), url_host(F.col(url_col)).alias("host")
    )
    read = rows.join(winners, "host", "left").select("id", "url", "html", "paths", "barred").mapInArrow(_texts, "id long, url string, text string")
    return read.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
