"""HTML extraction by templates deduced from equivalence classes of tokens.

A page is read as tokens: opening and closing tags with the path they stand on,
and the text of each block between them. Two tokens of a host are equivalent when they occur
equally often on each page of the host. Every page adds a hash of itself and the
number of occurrences to a token's fingerprint; equal fingerprints are equal
occurrence vectors, without any host's pages ever being gathered in one place. A
class is valid when it has at least LEAST_TOKENS tokens and stands on more than
half of the host's pages. The class with one occurrence on each of its pages that
stands on most of them is the template's frame; its tags in page order cut the
page into slots. Every other valid class is nested into the slot that holds its
mean place, as a slot that may repeat there.

The template decides what a slot is. The frame's slots in an article element are
the article; where there are none, those in a main element; where there are none
of those either, all slots of the body. A slot whose path leads through a menu,
header, footer, sidebar, notice, advert, form, comment section, script or style
is dropped. Outside the article, a slot of the frame or of a nested class whose
text is for the most part that of links, over all pages of the host, is a menu
and is dropped; so is every text that itself belongs to a valid class of at least
4/5 of the host's pages, for that is the template's own text. In an article,
nothing else is dropped. Text in an element that the template doesn't know (an
aside on a few pages) is judged by its own path.

A host needs two different pages to have a template: copies of one page don't
tell its text from the frame, and blank pages don't count. All other pages take that of all pages together.

Blocks are cut by every element that isn't inline; br is white space.

Cases: null and empty html give an empty text; a null url is the host ''; rows
with the same id are each extracted; broken markup is read to its end in linear
time: after a tag whose quotes never close, a tag ends at the next >; elements
nested deeper than DEEP share their ancestor's path; an end tag without a start
is passed over; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.session import written

#: A class has at least the start and the end of an element.
LEAST_TOKENS, DEEP = 2, 200
#: Templates up to this many bytes in all go to every task; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style noscript template textarea title".split()}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
UNWANTED = frozenset("nav footer aside form script style noscript template textarea title head button select option svg iframe object menu dialog canvas audio video".split())
UNWANTED_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|breadcrumbs?|masthead|footer|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|disqus|replies|reply|respond|widget|toolbar|pagination|pager|skip)(?:$|[\s_-])",
    re.I,
)


def _element(name: str, attributes: str) -> str:
    """The element as it stands in paths: its name, with ! where it is unwanted by its names."""
    names = " ".join(m.strip("\"'") for m in _NAMES.findall(attributes)) if "=" in attributes else ""
    shown = name + ("." + ",".join(sorted(names.replace("/", "_").split())) if names else "")
    return "!" + shown if names and UNWANTED_NAME.search(names) else shown


def _name(shown: str) -> str:
    return shown.lstrip("!").split(".", 1)[0]


def markup(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, "") | ("start" | "end", name, attributes) | ("raw", name, ""), in one pass."""
    at, end, unclosed = 0, len(page), False
    while at < end:
        tag = page.find("<", at)
        if tag != at:
            yield "text", page[at : tag if tag >= 0 else end], ""
            if tag < 0:
                return
            at = tag
        if page.startswith("<!--", at):
            at = page.find("-->", at + 4)
            if at < 0:
                return
            at += 3
            continue
        m = _TAG.match(page, at)
        if m is None and page[at + 1 : at + 2] not in ("!", "?"):
            yield "text", "<", ""
            at += 1
            continue
        close = None if unclosed or m is None else _ATTRIBUTES.match(page, m.end())
        if close is not None:
            stop = close.end()
        else:
            unclosed = unclosed or m is not None
            stop = page.find(">", at) + 1
            if not stop:  # no tag can end any more
                yield "text", page[at:], ""
                return
        if m is None:
            at = stop
            continue
        name = m[2].lower()
        if not m[1] and name in RAW:
            yield "raw", name, ""
            finish = RAW[name].search(page, stop)
            if finish is None:
                return
            at = finish.end()
        else:
            yield ("end" if m[1] else "start"), name, page[m.end() : stop - 1]
            at = stop


def events(page: str) -> Iterator[tuple[str, str, str, int]]:
    """("open" | "close", element, path, 0) | ("text", what stands between two of these in one space each, path, its characters in links)."""
    names: list[str] = []  # open elements
    shown: list[str] = []
    paths = [""]
    over, link, linked = 0, False, 0
    pieces: list[str] = []

    def leave(n: int) -> str:
        last = shown[n]
        del names[n:], shown[n:], paths[n + 1 :]
        return last

    for kind, what, attributes in markup(page):
        if kind == "text":
            what = html.unescape(what)
            pieces.append(what)
            linked += len(what) * link
            continue
        if kind != "raw" and what in INLINE:
            if what == "a":
                link = kind == "start"
            elif what == "br":
                pieces.append(" ")
            continue
        if kind == "end" and (over or what not in names):  # closes nothing that has a path
            over -= over > 0
            pieces.append(" ")
            continue
        if text := " ".join("".join(pieces).split()):
            yield "text", text, paths[-1], min(linked, len(text))
        pieces.clear()
        link, linked = False, 0
        if kind == "raw":
            yield "open", what, paths[-1], 0
        elif kind == "end":
            left = leave(len(names) - 1 - names[::-1].index(what))
            yield "close", left, paths[-1], 0
        else:
            if what in CLOSES_P and names and names[-1] == "p" and not over:
                leave(len(names) - 1)
            element = _element(what, attributes)
            yield "open", element, paths[-1], 0
            if what not in VOID and not attributes.endswith("/"):
                if len(names) < DEEP:
                    paths.append(f"{paths[-1]}/{element}" if names else element)
                    names.append(what)
                    shown.append(element)
                else:
                    over += 1
    if text := " ".join("".join(pieces).split()):
        yield "text", text, paths[-1], min(linked, len(text))


def _unwanted(path: str) -> bool:
    article = False
    for x in path.split("/"):
        name = x.split(".", 1)[0]
        article = article or name in ("article", "main")
        if x[:1] == "!" or name in UNWANTED or (name == "header" and not article):
            return True
    return False


def _inside(path: str, element: str) -> bool:
    return any(x.split(".", 1)[0] == element for x in path.split("/"))


def _key(kind: str, what: str, path: str) -> str:
    """A token as text; free text is known by its digest."""
    if kind == "text":
        what = xxhash.xxh64_hexdigest(what.encode("utf-8", "surrogatepass"))
    return f"{kind} {path} {what}"


def slot_path(token: str) -> str:
    """The path of what follows a tag."""
    kind, path, what = token.split(" ", 2)
    if kind == "open" and _name(what) not in VOID:
        return f"{path}/{what}" if path else what
    return path


def page_tokens(page: str) -> dict[str, list[int]]:
    """For each token its occurrences, the place of its first, and the characters and linked characters that directly follow it."""
    found: dict[str, list[int]] = {}
    last = None
    for i, (kind, what, path, linked) in enumerate(events(page)):
        k = _key(kind, what, path)
        now = found.setdefault(k, [0, i, 0, 0])
        now[0] += 1
        if kind != "text":
            last = now
        elif last is not None:
            last[2] += len(what)
            last[3] += linked
    return found


TOKENS = "host string, token string, low bigint, high bigint, own bigint, n bigint, place bigint, chars bigint, linked bigint"


def _token_rows(batches):
    names = [c.split()[0] for c in TOKENS.split(", ")]
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            rows = []
            for host, page in zip(*[c.to_pylist() for c in batch.slice(lo, 256).columns], strict=True):
                own = xxhash.xxh64_intdigest((page or "").encode("utf-8", "surrogatepass"))
                for k, (n, place, chars, linked) in page_tokens(page or "").items():
                    h = xxhash.xxh64_intdigest(f"{own} {n}")
                    rows.append((host, k, h & 0xFFFFFFFF, h >> 32, own - (1 << 63), n, place, chars, linked))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(columns)], names)


def host_of(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _measures(pages, least, most, first, last) -> list:
    sums = [F.sum(c).alias(c) for c in ("low", "high", "place", "chars", "linked")]
    return [*sums, pages.alias("pages"), F.min(least).alias("least"), F.max(most).alias("most"), F.min(first).alias("first"), F.max(last).alias("last")]


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): for every host with two different pages, and under '*' for all pages together.

    pages: host, html. The tokens that stand on more than half of a host's pages
    number at most twice the tokens of its mean page, which bounds a template.
    """
    tokens = pages.select("host", "html").mapInArrow(_token_rows, TOKENS)
    by_host = written(tokens.groupBy("host", "token").agg(*_measures(F.count("*"), "n", "n", "own", "own")), "tokens")
    content = F.xxhash64(F.coalesce("html", F.lit("")))
    sizes = pages.where(F.btrim("html", F.lit(" \t\n\x0b\x0c\r")) != "").groupBy("host").agg(F.count("*").alias("total"), (F.min(content) != F.max(content)).alias("differ"))
    sizes = written(sizes, "sizes")
    total = sizes.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    everywhere = by_host.groupBy("token").agg(*_measures(F.sum("pages"), "least", "most", "first", "last")).where(2 * F.col("pages") > total)
    common = by_host.join(sizes.where("differ"), "host").where(2 * F.col("pages") > F.col("total")).drop("differ")
    common = common.unionByName(everywhere.select(F.lit("*").alias("host"), "*", F.lit(total).cast("bigint").alias("total")))
    member = F.struct((F.col("place") / F.col("pages")).alias("place"), "token", "chars", "linked")
    same = ["host", "total", "low", "high", "pages"]
    classes = common.groupBy(*same).agg(F.min("least").alias("least"), F.max("most").alias("most"), (F.min("first") != F.max("last")).alias("differ"), F.sort_array(F.collect_list(member)).alias("tokens"))
    valid = classes.where(F.size("tokens") >= LEAST_TOKENS)
    found = valid.groupBy("host", "total").agg(F.collect_list(F.struct("pages", "least", "most", "differ", "tokens")).alias("classes"))
    return found.mapInArrow(_template_rows, "host string, template string")


def _template_rows(batches):
    for batch in batches:
        rows = [(h, json.dumps(deduce(c, n))) for h, n, c in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["host", "template"])


def _menu(token: dict) -> bool:
    return 2 * token["linked"] > token["chars"]


def deduce(classes: list[dict], total: int) -> dict:
    """frame: its tags in page order; keep: a verdict for each of its slots; nested: for each slot its repeating slots that are
    dropped; constant: the template's own texts; core: the element that holds the article ("article", "main" or "" for the body)."""
    once = [c for c in classes if c["least"] == c["most"] == 1]
    if not once:
        return {}
    outer = max(once, key=lambda c: (c["pages"], len(c["tokens"]), c["tokens"][0]["token"]))
    tags = sorted(((t["place"], t["token"], t) for t in outer["tokens"] if not t["token"].startswith("text ")), key=lambda x: x[:2])
    frame, paths = [k for _, k, _ in tags], [slot_path(k) for _, k, _ in tags]
    core = next((e for e in ("article", "main") if any(_inside(p, e) and not _unwanted(p) for p in paths)), "")
    keep = []
    for p, (_, _, t) in zip(paths, tags, strict=True):
        home = _inside(p, core) if core else _inside(p, "body") and not _menu(t)
        keep.append(home and not _unwanted(p))
    nested: list[list[str]] = [[] for _ in frame]
    constant = []
    for c in classes:
        mean = sum(t["place"] for t in c["tokens"]) / len(c["tokens"])
        slot = sum(place <= mean for place, _, _ in tags) - 1
        for t in c["tokens"]:
            token = t["token"]
            if token.startswith("text "):
                if c["differ"] and 5 * c["pages"] >= 4 * total and not _inside(token.split(" ", 2)[1], core or "article"):
                    constant.append(token)
            elif c is not outer and slot >= 0 and _menu(t) and not _inside(slot_path(token), core or "article"):
                nested[slot].append(token)
    return {"frame": frame, "keep": keep, "nested": nested, "constant": constant, "core": core}


def extract(page: str | None, template: dict) -> str:
    """The main text of one page."""
    frame, keep, nested = template.get("frame", []), template.get("keep", []), template.get("nested", [])
    constant, core = frozenset(template.get("constant", ())), template.get("core", "")
    place = {t: i for i, t in enumerate(frame)}
    homes = [_inside(slot_path(t), core) if core else _inside(slot_path(t), "body") for t in frame]
    read = list(events(page or ""))
    own_core = next((e for e in ("article", "main") if any(k == "open" and _name(w) == e and not _unwanted(p) for k, w, p, _ in read)), "")
    slot, menu, blocks = -1, False, []
    judged: dict[str, bool] = {}

    def wanted(path: str) -> bool:
        """The verdict of the frame's slot, or of the path itself where it has left what the slot stands in."""
        home = _inside(path, core or "article") if core else _inside(path, "body")
        if slot >= 0 and home == homes[slot]:
            inside = keep[slot]
        else:
            inside = _inside(path, own_core) if own_core else True
        return inside and not _unwanted(path)

    for kind, what, path, _ in read:
        if kind == "text":
            if path not in judged:
                judged[path] = wanted(path)
            if judged[path] and not menu and not (constant and _key(kind, what, path) in constant):
                blocks.append(what)
        else:
            token = _key(kind, what, path)
            at = place.get(token, -1)
            if at > slot:
                slot = at
                judged.clear()
            menu = slot >= 0 and token in nested[slot]
    return "\n".join(blocks)


def _extract_rows(batches):
    known: dict[str, dict] = {}
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            page_id, url, pages, own = batch.slice(lo, 256).columns
            out = []
            for page, t in zip(pages.to_pylist(), own.to_pylist(), strict=True):
                if t not in known:
                    if len(known) > 4096:
                        known.clear()
                    known[t] = json.loads(t) if t else {}
                out.append(extract(page, known[t]))
            yield pa.RecordBatch.from_arrays([page_id, url, pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    found = written(templates(rows), "templates")
    shared = next((r.template for r in found.where("host = '*'").collect()), None)
    own = found.where("host != '*'")
    size = own.agg(F.sum(F.octet_length("template"))).first()[0] or 0
    own = F.broadcast(own) if size <= BROADCAST_BYTES else own.hint("merge")
    laid = rows.join(own, "host", "left").select("page_id", "url", "html", F.coalesce("template", F.lit(shared).cast("string")).alias("template"))
    return laid.mapInArrow(_extract_rows, f"page_id {kind}, url string, text string, n_chars bigint")
