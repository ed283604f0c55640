"""Operator 5: main text of web pages by consensus host paths.

1. Each page is parsed once: its containers are scored by the text of their blocks, less links, and the page votes for the
   generalised tag-class path (digits masked, ids left out) of its best container, widened to the outermost article
   around it and further containers that add text with few links.
2. Spark adds the votes by host and path; a host's winner has the most weight.
3. Each page is parsed again and its text taken from the containers on the winning path, widened on that page in the same
   way; a page without one uses its own best container.

Boilerplate subtrees (navigation, site headers and footers, sidebars, notices, adverts, forms, comments, hidden
elements) are left out by tag, role and names.  A name counts by the first or last part of a class or id, and never for a
subtree that holds an article; names of ``_DOUBT`` (``related``, ``banner`` ...) drop a subtree only if its text is not
prose.  Parsing takes time linear in the page: a tag that never closes is text, and elements nested deeper than
``MAX_DEPTH`` are part of the one at that depth.  Winners are broadcast while they are at most ``MAX_BROADCAST`` hosts;
beyond that the join is by shuffle.

Defined results: a null or empty page has text '' and n_chars 0; a null url shares the empty host; a page without any
markup is one block.  Repeated rows give repeated results.  Further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.deploy import ship
from .shared import Stages, pieces

MAX_BROADCAST = 100_000

#: Text, paths of the containers around it (outermost first), characters in links.
Block = tuple[str, tuple[str, ...], int]
MAX_DEPTH = 256
_NAME = re.compile(r"(/?)([a-zA-Z][^\s/<>]*)")
_TAG_BODY = re.compile(r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+""")
_PLAIN_BODY = re.compile(r"[^<>]*+")
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_RAW = {k: re.compile(rf"</{k}\b[^>]*>?", re.I) for k in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_CONTAINER = frozenset("article body dd div main section td".split())
_DROP = frozenset("aside audio button canvas datalist dialog footer form head input map menu nav object select svg template video".split())
_DROP_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
_DROP_WORD = frozenset("ad ads advert advertisement breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices overlay pagination pager promoted replies sharing sidebar signup social sponsor sponsored subscribe toolbar".split())
_DOUBT = frozenset("banner popup promo recommended related share widget".split())
#: Of these, words that also name topics: with other words beside them (``ad-hoc``, ``menu-history``) the text decides.
_TOPIC = frozenset("ad ads advert comment comments menu modal nav navigation notice notices overlay replies sharing social sponsor".split())
#: Words of a name that say nothing about its subject.
_NEUTRAL = frozenset(
    "all area articles author bar block body bottom box btn button buttons card cards col column container content count counter desktop entry facebook fb feed fixed footer form global google grid group header holder home icon icons id inner item items "
    "js label layout left link links list main meta mobile module news outer page panel post posts primary reader reading region reply response responses right row secondary section site slot sticky stories table text thread title top topics tree "
    "twitter unit user video videos view wide wrap wrapper x zone".split()
)
_NEGATED = frozenset("has no with without".split())
_SENTENCE = re.compile(r"[.!?。！？؟](?:\s|$)")
#: Tags that an opening tag closes if they are open, up to the nearest barrier.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = frozenset("article aside body dl div footer form header html main nav ol section table td th ul".split())
_P_ENDS = _BLOCK - {"option", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SPLIT = re.compile(r"[^a-z0-9]+")


def _hidden(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether tag, role or style says that the subtree is no content."""
    if tag in _DROP or tag == "header" and not inside:
        return True
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _DROP_ROLE or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def _named(tag: str, attrs: dict[str, str]) -> int:
    """3 if class or id names boilerplate, 2 if it may, 1 if it has such a word beside words of another subject, else 0."""
    found = 0
    if tag not in ("body", "html", "main", "article"):
        for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
            parts = [x for x in _SPLIT.split(name) if x]
            if parts and _NEGATED.isdisjoint(parts):
                ends = {parts[0], parts[-1]}
                drop, doubt = ends & _DROP_WORD, ends & _DOUBT
                subject = any(not (x in _NEUTRAL or x in _DROP_WORD or x in _DOUBT or len(x) < 2 or x.isdigit()) for x in parts)
                if drop:
                    found = max(found, 1 if subject and drop <= _TOPIC else 3)
                elif doubt:
                    found = max(found, 1 if subject else 2)
    return found


def _step(tag: str, attrs: dict[str, str]) -> str:
    kinds = sorted({re.sub(r"\d+", "#", c) for c in attrs.get("class", "").lower().replace(">", "").split()})
    return ".".join([tag, *kinds])


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, '', '') for text, else ('', tag, rest of the tag); a closing tag's name starts with a slash."""
    at, end, failed = 0, len(page), 0
    while at < end:
        i = page.find("<", at)
        if i < 0:
            yield page[at:], "", ""
            return
        if i > at:
            yield page[at:i], "", ""
        at = i + 1
        mark = page[at : at + 1]
        if mark in ("!", "?") and mark:
            stop = ("-->", at + 3) if page.startswith("!--", at) else ("]]>", at + 8) if page.startswith("![CDATA[", at) else (">", at)
            k = page.find(*stop)
            if stop[0] == "]]>":
                yield entities.escape(page[at + 8 : k if k >= 0 else end]), "", ""
            if k < 0:
                return
            at = k + len(stop[0])
            continue
        m = _NAME.match(page, at)
        if not m:
            yield "<", "", ""
            continue
        k = -1
        if i >= failed:
            k = _TAG_BODY.match(page, m.end()).end()
            if page[k : k + 1] != ">":
                failed, k = k, -1
        if k < 0:
            k = _PLAIN_BODY.match(page, m.end()).end()
        if page[k : k + 1] != ">":
            yield page[i:k], "", ""
            at = k
            continue
        at = k + 1
        tag = m[2].lower()
        yield "", m[1] + tag, page[m.end() : k]
        if not m[1] and tag in _RAW:
            close = _RAW[tag].search(page, at)
            if not close:
                return
            at = close.end()


class _Subtree:
    """What is known of a subtree whose name is, or may be, boilerplate's (``level`` of :func:`_named`)."""

    def __init__(self, level: int):
        self.level, self.article, self.chars, self.links, self.blocks, self.sentences = level, False, 0, 0, 0, 0

    def dropped(self) -> bool:
        if self.article:
            return False
        running = self.sentences >= 1 and self.chars >= 40 * self.blocks and 10 * self.links < self.chars
        prose = running and self.chars >= 120 and self.sentences >= 2 and self.chars >= 60 * self.blocks
        return self.level == 3 or not (prose if self.level == 2 else running)


def parse(page: str) -> list[Block]:
    """The page's blocks in order: text, paths of the containers around it (outermost first), characters in links."""
    blocks: list[tuple[str, tuple[str, ...], int, tuple[_Subtree, ...]]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, whether it is a container, whether its name is boilerplate's
    paths: list[str] = [""]
    known: dict[tuple[str, str], str] = {}
    arounds: dict[str, tuple[str, ...]] = {}
    doubts: list[_Subtree] = []
    deep: dict[str, int] = {}
    buffer: list[str] = []
    skip = links = n_links = n_articles = 0

    def flush() -> None:
        nonlocal links
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                n = min(links, len(text))
                around = arounds.setdefault(paths[-1], ()) or tuple(paths[1:]) or ("",)
                arounds[paths[-1]] = around
                blocks.append((text, around, n, tuple(doubts)))
                if doubts:
                    ends = len(_SENTENCE.findall(text))
                    for d in doubts:
                        d.chars, d.links, d.blocks, d.sentences = d.chars + len(text), d.links + n, d.blocks + 1, d.sentences + ends
            buffer.clear()
        links = 0

    def close(k: int) -> None:
        """Close the elements from k of the stack on."""
        nonlocal skip, n_links, n_articles
        for tag, box, named in reversed(stack[k:]):
            if tag in _BLOCK:
                flush()
            if box:
                paths.pop()
            if named:
                doubts.pop()
            n_links -= tag == "a"
            n_articles -= tag in ("article", "main")
        del stack[k:]
        if skip > len(stack):
            skip = 0

    for text, tag, rest in _tokens(page):
        if not tag:
            if not skip:
                buffer.append(text)
                if n_links:
                    links += len(text)
            continue
        if tag[0] == "/":
            tag = tag[1:]
            if deep.get(tag):
                deep[tag] -= 1
                if tag in _BLOCK and not skip:
                    flush()
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
                if stack[k][0] in _BARRIER and tag not in _BARRIER:
                    break
            else:
                if tag in _BLOCK and not skip:
                    flush()
            continue
        if tag == "br":
            if not skip:
                buffer.append(" ")
            continue
        if tag in _RAW:
            continue
        if tag == "body" and any(t[0] == "head" for t in stack):
            close(next(k for k, t in enumerate(stack) if t[0] == "head"))
        ends = _CLOSES.get(tag, ())
        for k in range(len(stack) - 1, -1, -1):
            t = stack[k][0]
            if t in ends or t == "p" and tag in _P_ENDS:
                close(k)
                break
            if t in _BARRIER:
                break
        if tag in _BLOCK and not skip:
            flush()
        if tag in _VOID or rest.endswith("/") and tag in ("svg", "path"):
            continue
        if len(stack) >= MAX_DEPTH:
            deep[tag] = deep.get(tag, 0) + 1
            continue
        attrs = {a.lower(): entities.unescape(x or y or z or "") for a, x, y, z, _ in _ATTR.findall(rest) if a} if rest.strip() else {}
        if rest and re.search(r"(?:^|\s)hidden(?:\s|$)", rest):
            attrs["hidden"] = ""
        if not skip and _hidden(tag, attrs, n_articles > 0):
            skip = len(stack) + 1
        name = 0 if skip or not attrs else _named(tag, attrs)
        if name:
            doubts.append(_Subtree(name))
        if tag in ("article", "main"):
            n_articles += 1
            for d in doubts:
                d.article = True
        n_links += tag == "a"
        box = tag in _CONTAINER and not skip
        stack.append((tag, box, name > 0))
        if box:
            step = (paths[-1], _step(tag, attrs))
            if step not in known:
                known[step] = f"{step[0]}>{step[1]}"
            paths.append(known[step])
    close(0)
    flush()
    return [(t, a, n) for t, a, n, d in blocks if not any(x.dropped() for x in d)]


#: Containers that a block counts for (a third of a third each: the thirteenth would add less than a millionth); characters
#: that make an article beside the main one more than a teaser, or, beside a short one, this share of it.
REACH, BESIDE, SHARE = 12, 200, 0.2
#: Score at which a page's vote for a path grows no more, so that one long page does not outvote a host.
MOST_SCORE = 1e4


def best(blocks: list[Block]) -> tuple[str, float]:
    """Path of the container with the largest score, and the score: a block counts in full for its nearest container and by
    a third of the last for each further one."""
    own: dict[tuple[str, ...], float] = {}
    for text, around, links in blocks:
        own[around] = own.get(around, 0.0) + (len(text) - 2 * links) * (1 + 0.1 * min(text.count(","), 10))
    score: dict[str, float] = {}
    for around, worth in own.items():
        for k, path in enumerate(around[: -REACH - 1 : -1]):
            score[path] = score.get(path, 0.0) + worth / 3**k
    if not score:
        return "", 0.0
    path = max(score, key=lambda p: (score[p], -len(p), p))
    return path, score[path]


def totals(blocks: list[Block]) -> dict[str, tuple[int, int]]:
    """Characters and characters in links of everything inside each path."""
    own: dict[tuple[str, ...], tuple[int, int]] = {}
    for text, around, links in blocks:
        n, m = own.get(around, (0, 0))
        own[around] = (n + len(text), m + links)
    out: dict[str, tuple[int, int]] = {}
    for around, (n, m) in own.items():
        for path in around:
            a, b = out.get(path, (0, 0))
            out[path] = (a + n, b + m)
    return out


def kind(path: str) -> str:
    return path.rpartition(">")[2].split(".")[0]


def widen(blocks: list[Block], path: str) -> str:
    """The outermost article around a path, and from there outwards each container that adds text of which under a quarter
    is in links; the body only if no article or main is around."""
    return _widen(totals(blocks), {a for _, a, _ in blocks}, path)


def _widen(inside: dict[str, tuple[int, int]], arounds: set[tuple[str, ...]], path: str) -> str:
    around = next((a for a in arounds if path in a), (path,))
    outer = around[: around.index(path)][::-1]
    kinds = [kind(p) for p in (path, *outer)]
    framed = "article" in kinds or "main" in kinds
    first = max((k for k, tag in enumerate(kinds) if tag == "article"), default=0)
    path = (path, *outer)[first]
    for p, tag in zip(outer[first:], kinds[first + 1 :], strict=True):
        if tag == "body" and framed:
            continue
        n, links = (x - y for x, y in zip(inside[p], inside[path], strict=True))
        if n and 4 * links < n:
            path = p
    return path


def chosen(inside: dict[str, tuple[int, int]], path: str) -> set[str]:
    """The path and, if it is an article, the further articles beside it that are no teasers: of at least ``BESIDE`` characters, or
    ``SHARE`` of the main one if that is less, with few links."""
    if kind(path) != "article":
        return {path}
    parent = path.rpartition(">")[0]
    beside = {p: n for p, n in inside.items() if kind(p) == "article" and p.rpartition(">")[0] == parent}
    least = min(BESIDE, SHARE * inside[path][0])
    return {path, *(p for p, (n, links) in beside.items() if n >= least and 4 * links < n)}


def extract(blocks: list[Block], winner: str | None) -> str:
    """Blocks inside containers on the winning path, or on the page's own best path."""
    if not blocks:
        return ""
    inside, arounds = totals(blocks), {a for _, a, _ in blocks}
    path = winner if winner is not None and winner in inside else best(blocks)[0]
    paths = chosen(inside, _widen(inside, arounds, path))
    taken = {a for a in arounds if not paths.isdisjoint(a)}
    return "\n".join(text for text, around, _ in blocks if around in taken)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        found = [(widen(x, p) if x else p, s) for x in (parse(x or "") for x in b.column(1).to_pylist()) for p, s in (best(x),)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([min(s, MOST_SCORE) for _, s in found], pa.float64())], names=["host", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        texts = [extract(parse(x or ""), w) for x, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    spark = ship(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    votes = pages.select(host.alias("host"), "html").mapInArrow(_vote, "host string, path string, score double").where("score > 0")
    rank = Window.partitionBy("host").orderBy(F.col("weight").desc(), "path")
    sums = votes.groupBy("host", "path").agg(F.sum(F.log1p(F.floor("score"))).alias("weight"), F.count(F.lit(1)).alias("n"))
    winners = sums.withColumn("weight", F.round("weight", 6)).withColumn("r", F.row_number().over(rank)).where("r = 1").select("host", F.col("path").alias("winner"))
    winners = Stages(spark, "hosts").write(winners)
    side = F.broadcast(winners) if winners.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else winners
    id_kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html", host.alias("host")).join(side, "host", "left").select("page_id", "url", "html", "winner")
    return rows.mapInArrow(_extract, f"page_id {id_kind}, url string, text string, n_chars bigint")
