"""Main-text extraction from web pages by consensus paths per host.

Each page scores its containers by the running text directly below them and votes for the generalised tag-class path
of each. Spark sums the votes per host; the winning paths are then used to extract every page of that host. A
page on which no winning path covers enough falls back to its own best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, staged

#: Elements whose content is passed over as raw text.
RAW = re.compile(r"script|style|noscript|template|textarea|select|svg|iframe|title|object", re.I)
OPENING, CLOSING = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile(r"/([a-zA-Z][^\s/>]*)")
#: One attribute: its name, and where a value begins.
NAME, EQUALS, BARE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
TAG_END = re.compile(r"[\s/]*>")

#: Parts that a host's pages are dealt to.
SALTS = 16
#: A container is a candidate of its host when it wins this share of the host's votes, and is used on a page when it
#: holds this share of what the page's own best container scores.
WIN_SHARE, COVERS = 0.02, 0.75
#: A container's surroundings belong to it if this share of their text are paragraphs of at least so many characters
#: outside links, and they add at least this share to it.
RUNNING, PARAGRAPH, LEAST_PART = 0.8, 80, 0.05

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article body div main section td".split())
KEPT = frozenset("html body article main".split())
#: Containers whose classes are read part by part.
HOLDERS = frozenset("div section ul ol dl table td tr fieldset details figure blockquote".split())
DROPPED = frozenset("aside button dialog footer form header head input label menu nav noscript".split())
DROPPED_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROPPED_WORD = frozenset(
    "ad ads adbox advert advertisement advertising adverts banner banners breadcrumb breadcrumbs comment comments consent cookie cookies disqus"
    " footer form header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pagination pager"
    " popup promo promotion related reply replies respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe"
    " subscription tags teaser toolbar widget widgets".split()
)
#: Words of the list that are taken for boilerplate as parts of a name inside an article, and words that say nothing.
ARTICLE_WORD = DROPPED_WORD - {"header", "footer", "tags"}
NEUTRAL_WORD = frozenset("area bar block body box btn button buttons col column container content entry group holder inner item items left link links list main outer panel post posts right row section slot thread title top bottom unit wrap wrapper".split())
#: A form that holds this share of a page's text is the page itself.
WHOLE_FORM = 0.5


def host_of(url) -> object:
    """The host of a URL column, lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def step(tag: str, classes: list[str]) -> str:
    """A path step: the tag and its classes in order of name, digits made alike."""
    return ".".join([tag, *sorted({re.sub(r"\d+", "0", c) for c in classes})])


def boilerplate(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    """Whether an element is no part of the main text. A word of the list counts as a part of a container's class or id
    (inside an article: if the other parts only name a box or a list), for other elements only as a whole class or id."""
    if tag == "header" and inside_article:
        return False
    if tag in DROPPED or attrs.get("role", "").lower() in DROPPED_ROLE or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if tag in KEPT:
        return False
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split()
    if any(n in DROPPED_WORD for n in names):
        return True
    if tag not in HOLDERS:
        return False
    words = [{w for w in re.split(r"[^a-z]+", n) if w} for n in names]
    if inside_article:  # an article may have a part called share-price-report: all of a name must speak of boilerplate
        return any(w & ARTICLE_WORD and w <= ARTICLE_WORD | NEUTRAL_WORD for w in words)
    return any(w & DROPPED_WORD for w in words)


def attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag from `at` on, and the place behind its end; -1 if the tag has no end. A quotation mark only
    opens a quoted value right behind the equals sign."""
    found: dict[str, str] = {}
    while not (end := TAG_END.match(page, at)):
        name = NAME.match(page, at)
        if not name:
            return found, -1
        at, value = name.end(), ""
        if equals := EQUALS.match(page, at):
            at = equals.end()
            mark = page[at : at + 1]
            if mark in ("'", '"') and mark:
                close = page.find(mark, at + 1)
                if close < 0:
                    return found, -1
                value, at = page[at + 1 : close], close + 1
            else:
                bare = BARE.match(page, at)
                value, at = bare[0], bare.end()
        found.setdefault(name[1].lower(), html.unescape(value) if "&" in value else value)
    return found, end.end()


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", characters, {}), ("open", tag, attributes) and ("close", tag, {}) in page order; ("gap", "", {}) where
    raw text was passed over. Every character is read once; a tag without an end takes the rest of the page."""
    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield "text", page[at:], {}
            return
        if start > at:
            yield "text", page[at:start], {}
        at = start + 1
        if opening := OPENING.match(page, at):
            tag = opening[0].lower()
            attrs, at = attributes(page, opening.end())
            if at < 0:
                return
            if RAW.fullmatch(tag):
                yield "gap", "", {}
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                if not close:
                    return
                at = close.end()
            else:
                yield "open", tag, attrs
        elif closing := CLOSING.match(page, at):
            _, at = attributes(page, closing.end())
            if at < 0:
                return
            yield "close", closing[1].lower(), {}
        elif page.startswith("!--", at):
            close = page.find("-->", at + 1)
            if close < 0:
                return
            at = close + 3
        elif page[at : at + 1] in ("!", "?", "/"):
            close = page.find(">", at)
            if close < 0:
                return
            at = close + 1
        else:
            yield "text", "<", {}


def page_forms(page: list[tuple[str, str, dict[str, str]]]) -> set[int]:
    """Tokens that open a form which holds most of the page's text, as pages of some servers do."""
    upto, every, inside, found = 0, sum(len(said) for kind, said, _ in page if kind == "text"), [], set()
    for i, (kind, tag, _) in enumerate(page):
        if kind == "text":
            upto += len(tag)
        elif tag == "form" and kind == "open":
            inside.append((i, upto))
        elif tag == "form" and inside:
            opened, before = inside.pop()
            if upto - before >= WHOLE_FORM * every:
                found.add(opened)
    return found | {i for i, before in inside if upto - before >= WHOLE_FORM * every}


def blocks_of(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, linked) of each block of the page's kept part, in page order; path: steps from the root to
    the container above the block; linked: characters inside links."""
    found: list = []
    stack: list[tuple[str, str, bool]] = []  # tag, step, dropped
    places: dict[str, list[int]] = {}  # of the open elements of each tag, in the stack
    blocks: list[int] = []  # places of open blocks and of open containers
    containers: list[int] = []
    drops = articles = 0
    text: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join("".join(text).split())
            text.clear()
            if said:
                found.append((tuple(s for t, s, _ in stack if t in CONTAINER or t == "html"), said, linked))
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal drops, articles, links
        while len(stack) > depth:
            tag, _, dropped = stack[-1]
            if tag in BLOCK:
                flush()
                blocks.pop()
            if tag in CONTAINER:
                containers.pop()
            stack.pop()
            places[tag].pop()
            drops -= dropped
            articles -= tag in ("article", "main")
            links -= tag == "a"

    every = [*tokens(page)]
    forms = page_forms(every)
    for i, (kind, tag, attrs) in enumerate(every):
        if kind == "text":
            if not drops:
                said = html.unescape(tag)
                text.append(said)
                linked += len(said) if links else 0
            continue
        if kind == "gap":
            text.append(" ")
            continue
        if kind == "close":
            # the innermost open element of that name, unless it is no block and stands outside the innermost container
            if (open_ := places.get(tag)) and (tag in BLOCK or not containers or open_[-1] > containers[-1]):
                pop_to(open_[-1])
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br" and not drops:
                text.append(" ")
            continue
        if tag in BLOCK:
            above = stack[blocks[-1]][0] if blocks else None
            if above == "p" or above == tag and tag in ("li", "dt", "dd", "tr", "td", "th"):
                pop_to(blocks[-1])
            flush()
        dropped = i not in forms and boilerplate(tag, attrs, articles > 0)
        for kind_, own in ((BLOCK, blocks), (CONTAINER, containers)):
            if tag in kind_:
                own.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, step(tag, attrs.get("class", "").split()), dropped))
        drops += dropped
        articles += tag in ("article", "main")
        links += tag == "a"
    flush()
    return found


def scores(blocks: list) -> dict[tuple[str, ...], float]:
    """Score of each container: its own blocks' running text, and half of it for the container above."""
    out: dict[tuple[str, ...], float] = {}
    for path, said, linked in blocks:
        running = max(0, len(said) - 2 * linked)
        worth = running if len(said) >= 25 else running / 4
        if any(s.split(".")[0] in ("article", "main") for s in path):
            worth *= 2
        out[path] = out.get(path, 0.0) + worth
        if len(path) > 1:
            out[path[:-1]] = out.get(path[:-1], 0.0) + worth / 2
    return out


def best(score: dict) -> tuple[str, ...] | None:
    return max(score, key=lambda p: (score[p], -len(p), p)) if score else None


def whole(blocks: list, path: tuple[str, ...]) -> list[tuple[str, ...]]:
    """The containers that a page's text is taken from, if `path` won: the article (or else the main part) around it, so
    that titles, leads and sibling parts stay. Without one, the container and its siblings that are running text (of
    paragraphs, not of links or lines), and so on upwards as long as there are such siblings; a blank step at the end
    stands for a container's own blocks."""
    for tag in ("article", "main"):
        inside = [i for i, s in enumerate(path) if s.split(".")[0] == tag]
        if inside:
            return [path[: inside[-1] + 1]]
    taken = [path]
    while path:
        above, size = path[:-1], len(path) - 1
        own = sum(len(said) for p, said, _ in blocks if p[: size + 1] == path)
        siblings: dict[tuple[str, ...], list[tuple[str, int]]] = {}
        for p, said, linked in blocks:
            if p[:size] == above and p[: size + 1] != path:
                siblings.setdefault(p[: size + 1] if len(p) > size else (*above, ""), []).append((said, linked))
        for p, parts in siblings.items():
            added = sum(len(said) for said, _ in parts)
            running = sum(len(said) - linked for said, linked in parts if len(said) >= PARAGRAPH)
            if running >= RUNNING * added and added >= LEAST_PART * own:
                taken.append(p)
        if len(taken) > 1 and (*above, "") in siblings and above and above[-1].split(".")[0] not in ("html", "body"):
            taken.append((*above, ""))
        path = above
    return taken


def joined(blocks: list, path: tuple[str, ...]) -> str:
    taken = {}
    for p in whole(blocks, path):
        taken.setdefault(len(p), set()).add(p)
    return "\n".join(said for own, said, _ in blocks if any((own[:n] if len(own) >= n else (*own, "")) in some for n, some in taken.items() if len(own) >= n - 1))


def chosen(blocks: list, paths: list[tuple[str, ...]]) -> tuple[tuple[str, ...] | None, bool]:
    """The container to take from a page, and whether its host's vote gave it: of the host's winning paths, first the
    one with most votes, that covers enough of the page's own best container; without one, that container."""
    score = scores(blocks)
    own = best(score)
    for p in paths:
        if score.get(p, 0.0) > 0 and score[p] >= COVERS * score[own]:
            return p, True
    return own, False


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, host, path (the winning path of the host that was used, null if the page used its
    own).

    Every container with running text votes, with its share of the page's score. The paths that win WIN_SHARE of a
    host's votes (so at most 1 / WIN_SHARE of them) are its winning paths.

    Null or empty html gives an empty text; a null url is a host of its own (''); a null page_id is kept; repeated
    pages are extracted alike; a very long or broken page is read whole, in one pass; ties between paths go to the
    shorter, then the lesser path; an empty table gives no rows; further columns aren't read.
    """
    bounded_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))

    def vote(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            tally: dict[tuple[str, str], float] = {}
            for host, page in zip(f["host"], f["html"], strict=True):
                score = scores(blocks_of(page))
                total = sum(score.values())
                for p, worth in score.items():
                    if worth > 0:
                        key = (host, ">".join(p))
                        tally[key] = tally.get(key, 0.0) + worth / total
            yield pd.DataFrame([(*k, v) for k, v in tally.items()], columns=["host", "path", "worth"])

    cast = rows.select("host", "html").mapInPandas(vote, "host string, path string, worth double")
    tally = cast.groupBy("host", "path").agg(F.round(F.sum("worth"), 6).alias("worth"))  # rounded, as sums of doubles depend on order
    whole = tally.groupBy("host").agg(F.sum("worth").alias("_all")).withColumnRenamed("host", "_host")
    won = tally.join(whole, F.col("host") == F.col("_host")).where(F.col("worth") >= WIN_SHARE * F.col("_all"))
    winner = won.groupBy("_host").agg(F.array_sort(F.collect_list(F.struct((-F.col("worth")).alias("order"), F.length("path").alias("size"), "path"))).alias("paths"))
    # stored, so that the planner knows its size before it decides whether pages must move; a hot host is salted
    winner = staged(winner.select("_host", "paths.path"), "winning-paths").withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))

    def again(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, used = [], []
            for page, paths in zip(f["html"], f["path"], strict=True):
                blocks = blocks_of(page)
                path, voted = chosen(blocks, [tuple(p.split(">")) for p in paths] if paths is not None else [])
                texts.append(joined(blocks, path) if path else "")
                used.append(">".join(path) if voted else None)
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": texts, "n_chars": [len(t) for t in texts], "host": f["host"], "path": used})

    led = rows.join(winner, (F.col("host") == F.col("_host")) & (F.col("_salt") == F.col("_of")), "left")
    return led.select("page_id", "url", "html", "host", "path").mapInPandas(again, "page_id long, url string, text string, n_chars long, host string, path string")
