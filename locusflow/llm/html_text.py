"""Main text of web pages, with site templates removed.

Each page is parsed into elements once to count and once to extract. Counting: the subtrees of a page are hashed, and Spark
counts for every host on how many different pages a hash stands. Extraction: subtrees
that recur across many pages of the host are deleted, then menus, headers, footers, sidebars, notices, adverts, forms,
scripts and comments by tag, role and class. Inside an article only boxes (INNER) count, and they must stand on a larger share
of the host's pages: a paragraph that an author repeats is text. A page keeps them if nothing else is in its article.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.ngrams import mix
from locusflow.session import persisted, prepare_workers, release

#: A subtree is a template if it stands on so many different pages of its host, and on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.2
#: The share inside of an article.
INNER_SHARE = 0.5
#: Template hashes are sent to every task up to so many (8 bytes each); beyond that they are joined to the pages.
BROADCAST_HASHES = 200_000

# Element names of HTML and words that name parts of pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe option".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
INNER = frozenset("aside center details dialog div dl fieldset figure footer form header menu nav ol section table ul".split())
SKIP = frozenset("aside audio button canvas dialog footer form head menu nav object select svg template video".split())
CLOSES_P = BLOCK - frozenset("br td th tr tbody thead tfoot caption html body head title option".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split())
OUTSIDE = frozenset("branding copyright header legal login logo search skip topbar".split())
#: Parts of a name that say where or what kind of box, not what is in it, and ones that turn a name into a state.
PLACES = frozenset("area articles bar block bottom box button buttons col column container content form group holder icons inner item items left link links list outer panel posts right row section slot stories text top unit wrap wrapper zone".split())
STATES = frozenset("has hide is no non not show with without".split())
COMMENTS = frozenset("comments commentlist disqus replies respond".split())
HEADINGS_AND_INLINE = frozenset("a abbr b bdi bdo cite code em font h1 h2 h3 h4 h5 h6 i kbd label mark q s small span strong sub sup time u var".split())
_UNSEEN = re.compile(r"(?i)(?:^|;)\s*display\s*:\s*none")

#: Comments, tags, declarations; a quote opens a value only after an equals sign. What begins like a tag and isn't one as
#: far as the page goes comes last: from there on a tag ends at the next ``>``, quotes or not, so no page takes long.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>|<[!?][^>]*+(?:>|\Z)|<(?=/?[a-zA-Z])""", re.S)
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+(?:>|\Z)", re.S)
#: Name and value of each attribute of a tag; what looks like one inside a value isn't.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+|["'/=]""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_PART = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")
#: Base of the polynomial over a page's tokens, modulo 2**64 (odd, so it has an inverse).
_BASE = 0x9E3779B97F4A7C15


def host_of(url: str | None) -> str:
    """The host of a URL in lower case; empty if there is none."""
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


@lru_cache(4096)
def named(value: str, words: frozenset) -> int:
    """Whether a class or id names one of the words: 2 as a name of its own, 1 inside a longer one, 0 not at all.

    A longer name counts by its last part, after parts that only say where (``footer-left``, ``related-posts``): what
    stands before describes, so ``related-work`` is work. A name that begins with a state (``no-sidebar``) isn't one.
    """
    best = 0
    for name in value.split():
        if name.lower() in words:
            return 2
        parts = [x.lower().rstrip("0123456789") for x in _PART.split(name)]
        while len(parts) > 1 and (not parts[-1] or parts[-1] in PLACES):
            parts.pop()
        if parts[-1] in words and not STATES.intersection(parts):
            best = 1
    return best


#: Why an element is left out: it is named as what readers write, which may be longer than the article.
COMMENT = 3


class Page:
    """A page's text pieces and elements, by position in the token stream. Reading takes time in proportion to the page.

    texts: (position, raw text); breaks: positions where a block begins or ends; elements: [tag, first and last position,
    why it is left out (0 not, 1 by a name, COMMENT by a name of readers' comments, 2 by tag, role or being hidden)];
    hashes: a hash of each position's token.
    """

    def __init__(self, source: str):
        self.texts: list[tuple[int, str]] = []
        self.breaks: list[int] = []
        self.elements: list[list] = []
        self.hashes: list[int] = []
        stack: list[list] = []
        self._blocks: list[int] = []  # places of block elements on the stack
        self._open: Counter = Counter()
        at, k, token, last = 0, 0, _TOKEN, source.rfind(">")
        while True:
            m = token.search(source, at) if at <= last or source.find("<!", at) >= 0 or source.find("<?", at) >= 0 else None
            if m and m[2] is None and m.end() == m.start() + 1:
                token = _LOOSE
                m = token.search(source, at)
            end = m.start() if m else len(source)
            if end > at:
                self.texts.append((k, source[at:end]))
                self._token(source[at:end])
                k += 1
            if not m:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            tag = name.lower()
            if tag in BLOCK:
                self.breaks.append(k)
            k += 1
            if m[1]:
                self._token(m[0])
                if self._open[tag]:
                    i = len(stack) - 1
                    while stack[i][0] != tag:
                        i -= 1
                    self._close(stack, i, k)
                continue
            if tag in CLOSES_P and self._blocks and stack[self._blocks[-1]][0] == "p":
                self._close(stack, self._blocks[-1], k - 1)
            if tag in RAW:
                stop = _RAW_END[tag].search(source, at)
                at = stop.end() if stop else len(source)
                self._token(source[m.start() : at])
                continue
            self._token(m[0])
            if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
                continue
            if tag in BLOCK:
                self._blocks.append(len(stack))
            stack.append([tag, k - 1, k, self._left_out(tag, m[3])])
            self._open[tag] += 1
        self.size = k
        self._close(stack, 0, k)
        self._decide()

    def _token(self, text: str) -> None:
        """White space between words counts as one space, and a token of white space as nothing."""
        text = " ".join(text.split())
        self.hashes.append(xxhash.xxh3_64_intdigest(text) | 1 if text else 0)

    def _left_out(self, tag: str, attributes: str) -> int:
        within = self._open["article"] or self._open["main"]
        if tag in SKIP or tag == "header" and not within:
            return 2
        if not attributes.strip():
            return 0
        out, named_so = 0, 0
        for m in _ATTRIBUTE.finditer(attributes):
            if not m[1]:
                continue
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _UNSEEN.search(value):
                return 2
            if name == "role" and value.strip().lower() in ROLES:
                out = 2
            elif (name == "class" or name == "id" and tag not in HEADINGS_AND_INLINE) and tag not in ("body", "html", "main"):
                if named(value, COMMENTS) == 2:
                    named_so = COMMENT
                elif named(value, NAMES) or not within and tag in ("div", "section", "p", "ul", "table", "span") and named(value, OUTSIDE):
                    named_so = named_so or 1
        return out or named_so

    def _close(self, stack: list, down_to: int, k: int) -> None:
        while len(stack) > down_to:
            e = stack.pop()
            e[2] = k
            self._open[e[0]] -= 1
            self.elements.append(e)
        while self._blocks and self._blocks[-1] >= down_to:
            self._blocks.pop()

    def _cover(self, elements: list[list]) -> np.ndarray:
        """How many of the elements each position lies in."""
        out = np.zeros(self.size + 2, np.int64)
        for e in elements:
            out[e[1]] += 1
            out[e[2]] -= 1
        return np.cumsum(out)

    def _decide(self) -> None:
        """Settles what a name leaves out: not what holds an article or most of the text around it.

        Readers' comments may be most of the text, but not all of it. Of outermost articles, a name only decides if
        another one isn't named.
        """
        away = self._cover([e for e in self.elements if e[3] == 2])
        doubt = sorted((e for e in self.elements if e[3] in (1, COMMENT)), key=lambda e: (e[1], -e[2]))
        letters = np.zeros(self.size + 2, np.int64)
        for k, raw in self.texts:
            if not away[k]:
                letters[k + 1] = len(raw.strip())
        letters = np.cumsum(letters)
        for tag in ("article", "main"):
            mains = [e for e in self.elements if e[0] == tag and not away[e[1]]]
            if mains and all(e[3] for e in mains):
                around = self._cover(mains)
                for e in mains:
                    if around[e[1]] == 1:
                        e[3] = 0
        mains = [e for e in self.elements if e[0] in ("article", "main") and e[3] == 0 and not away[e[1]]]
        around = sorted((e[1], e[2]) for e in mains)
        starts = [a for a, _ in around]
        for e in doubt:
            # Inside an article its text is the measure, else the page's; what holds an article stays.
            i = bisect_right(starts, e[1]) - 1
            inside = i >= 0 and around[i][1] >= e[2]
            a, b = around[i] if inside else (0, self.size)
            j = bisect_right(starts, e[1])
            holds = j < len(around) and around[j][1] <= e[2]
            own, all_of = letters[e[2]] - letters[e[1]], letters[b] - letters[a]
            if holds or (inside or not around) and (own == all_of > 0 if e[3] == COMMENT else 2 * own > all_of):
                e[3] = 0
        gone = self._cover([e for e in self.elements if e[3]])
        self.main: list[list] = []
        for tag in ("article", "main"):
            found = [e for e in self.elements if e[0] == tag and not e[3] and not gone[e[1]]]
            if found:
                self.main = found
                break

    def subtrees(self) -> list[tuple[int, list]]:
        """(hash, element) of block elements outside the main part and boxes in it; white space doesn't count.

        The main part are the page's articles, else its main element, else there is none. A subtree's hash is a
        polynomial over its tokens' hashes, taken from running sums. The lowest bit says if the element is inside.
        """
        with np.errstate(over="ignore"):
            tokens = np.array(self.hashes, np.uint64)
            number = np.cumsum(np.append(0, tokens != 0))  # tokens of white space take no place
            powers, inverses = _powers_of(len(tokens) + 1)
            sums = np.append(np.uint64(0), np.cumsum(tokens * powers[number[:-1]], dtype=np.uint64))
        inside = self._cover(self.main)
        starts = sorted(e[1] for e in self.main)
        chosen, kinds = [], []
        for e in self.elements:
            if e[0] not in BLOCK or e[0] in ("html", "body", "head"):
                continue
            i = bisect_left(starts, e[1])
            if i < len(starts) and starts[i] < e[2]:
                continue  # it holds an article, or is one
            inner = bool(inside[e[1]])
            if not inner or e[0] in INNER:
                chosen.append(e)
                kinds.append(inner)
        if not chosen:
            return []
        a, b = np.array([e[1] for e in chosen]), np.array([e[2] for e in chosen])
        with np.errstate(over="ignore"):
            value = mix((sums[b] - sums[a]) * inverses[number[a]] + (number[b] - number[a]).astype(np.uint64))
        value = (value.view(np.int64) & ~1) | np.array(kinds, np.int64)
        return list(zip(value.tolist(), chosen, strict=True))

    def text(self, templates) -> str:
        """The main text; templates is a test for hashes of subtrees to delete."""
        gone = [(h, e) for h, e in self.subtrees() if templates(h)]
        outer = [e for h, e in gone if not h & 1]
        return self._text([e for _, e in gone]) or (self._text(outer) if len(outer) < len(gone) else "")

    def _text(self, deleted: list[list]) -> str:
        cover = self._cover([e for e in self.elements if e[3]] + deleted)
        inside = self._cover(self.main) if self.main else np.ones(self.size + 2, np.int64)
        blocks: list[list[str]] = [[]]
        breaks, b = self.breaks, 0
        for k, raw in self.texts:
            if b < len(breaks) and breaks[b] < k:
                blocks.append([])
                while b < len(breaks) and breaks[b] < k:
                    b += 1
            if inside[k] > 0 and cover[k] <= 0:
                blocks[-1].append(unescape(raw) if "&" in raw else raw)
        return " ".join(x for x in (" ".join("".join(p).split()) for p in blocks) if x)


_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_of(n: int) -> list[np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse."""
    if len(_tables[0]) < n:
        for i, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(2 * n, x, np.uint64)
            step[0] = 1
            _tables[i] = np.cumprod(step, dtype=np.uint64)
    return _tables


def _host_hash(host: str, subtree: int) -> int:
    """One number for a subtree of a host, with the subtree's lowest bit."""
    return (xxhash.xxh3_64_intdigest(f"{host}\n{subtree}") - (1 << 63)) & ~1 | subtree & 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, subtree, page): subtree null for the page itself; page is a digest, so copies of a page are one."""
    for batch in batches:
        hosts, trees, pages = [], [], []
        for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            host, digest = host_of(url), xxhash.xxh3_64_intdigest(html) - (1 << 63)
            found = {_host_hash(host, h) for h, _ in Page(html).subtrees()}
            hosts += [host] * (len(found) + 1)
            trees += [None, *sorted(found)]
            pages += [digest] * (len(found) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(trees, pa.int64()), pa.array(pages, pa.int64())], ["host", "tree", "page"])


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(tree): subtrees that stand on many different pages of their host. Counts are partial before they are moved."""
    prepare_workers(pages.sparkSession)
    source = pages.select(url_col, F.coalesce(F.col(html_col), F.lit("")).alias(html_col))
    seen = persisted(source.mapInArrow(_count, "host string, tree long, page long").distinct(), "subtrees")
    own = seen.where("tree IS NULL").groupBy("host").agg(F.count("*").alias("pages"))
    trees = seen.where("tree IS NOT NULL").groupBy("host", "tree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    share = F.when(F.col("tree").bitwiseAND(1) == 1, max(min_share, INNER_SHARE)).otherwise(min_share)
    out = persisted(trees.join(own, "host").where(F.col("n") >= share * F.col("pages")).select("tree"), "templates")
    release(seen)
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """One row per input row: (id_col, url_col, text, n_chars).

    Character references are decoded, white space in a block becomes one space, blocks are joined by one space in page
    order; a page without text has an empty one. Null html counts as empty, a null url as a host of its own that all such
    pages share. Equal pages give equal rows and count once for templates. Broken markup is read leniently: what isn't
    closed ends with the page. Other columns are ignored; no pages give no rows.
    """
    spark = pages.sparkSession
    templates = site_templates(pages, url_col, html_col, min_pages, min_share)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    kind = source.schema["id"].dataType.simpleString()
    shape = f"id {kind}, url string, text string, n_chars long"
    if templates.count() <= broadcast_hashes:
        known = frozenset(r[0] for r in templates.collect())
        release(templates)
        out = source.mapInArrow(_extract(known), shape)
    else:
        keyed = source.withColumn("key", F.xxhash64("url", "html"))
        trees = keyed.select("key", "url", "html").mapInArrow(_trees, "key long, tree long").distinct()
        lists = trees.hint("merge").join(templates.hint("merge"), "tree").groupBy("key").agg(F.collect_list("tree").alias("trees"))
        out = keyed.hint("merge").join(lists.hint("merge"), "key", "left").select("id", "url", "html", "trees").mapInArrow(_extract(None), shape)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, trees = [], []
        for key, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            host = host_of(url)
            found = {_host_hash(host, h) for h, _ in Page(html).subtrees()}
            keys += [key] * len(found)
            trees += sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(trees, pa.int64())], ["key", "tree"])


def _extract(known: frozenset | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(3).to_pylist() if known is None else [known] * part.num_rows
                texts = []
                for url, html, trees in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), lists, strict=True):
                    host, mine = host_of(url), frozenset(trees or ())
                    texts.append(Page(html).text(lambda h, host=host, mine=mine: _host_hash(host, h) in mine))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return run
