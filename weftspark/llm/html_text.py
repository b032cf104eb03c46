"""Main text of web pages: structure first, and page differencing for lines that no element places."""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, tune
from .urlgraph import host_path

#: A tag whose attribute values hold no angle bracket; nothing in it can be read in two ways, so a failure costs no more than the
#: way to the next bracket. Other tags are read step by step.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[\s/]+[^\s\"'<>=/]+(?:=(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s\"'<>=]+))?)*[\s/]*)>")
NAME, STEP, SPACE = re.compile(r"</?([a-zA-Z][^\s/>]*)"), re.compile(r"[>=]"), re.compile(r"\s*")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup. A page that never ends a script or style is over there, as in browsers; other ends that
#: are missing cost only the tag.
RAW, TO_END = frozenset("script style textarea title iframe noembed noframes xmp".split()), frozenset(("script", "style"))
INLINE = frozenset(
    "a abbr b bdi bdo big br button canvas cite code data datalist del dfn em embed font i iframe img input ins kbd label link map mark math meta noembed noscript object q s samp script select small source span strike strong style sub "
    "sup svg template textarea time track tt u var wbr".split()
)
MAIN, ASIDE = frozenset(("article", "main")), frozenset("nav header footer aside form menu dialog fieldset".split())
#: Elements that are set aside with what they hold, if they are ended.
HIDDEN = frozenset("noscript template svg math object canvas select button head datalist".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of class and id names for what is not the article, and words that may stand beside them. A name of such words alone
#: sets an element aside; where only some are marks, the nearest page decides line by line.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header login masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination popup promo promoted related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
BESIDE = frozenset("area bar block bottom box button buttons container content form gdpr global inner left link links list main outer overlay page panel primary reader right row secondary section site slot thread top unit user widgets wrap wrapper".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where a block lies: outside the article, in it, under a name with marks among other words (outside, in it), a heading in it.
OUT, IN, MAY_OUT, MAY_IN, TITLE = "01234"


def named(value: str) -> int:
    """2 if a class or id value names what is not the article, 1 if it holds such a word, else 0."""
    out = 0
    for name in value.split():
        parts = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        if marked := sum(w in MARKS for w in parts):
            out = max(out, 2 if all(w in MARKS or w in BESIDE or w.isdigit() for w in parts) else 1)
    return out


def set_aside(tag: str, text: str) -> int:
    """2 if an element's name or attributes set it aside, 1 if a class or id hints at it, else 0."""
    if tag in ASIDE or tag in HIDDEN:
        return 2
    if not text or tag in ("body", "html"):
        return 0
    out = 0
    for name, *values in ATTRIBUTE.findall(text):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name in ("class", "id"):
            out = max(out, named(value))
        if name == "role" and value.strip() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 2
    return out


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page in linear time: ('text', '', text), ('open', tag, attributes), ('close', tag, '')."""
    at, end, gone = 0, len(page), {}
    while at < end:
        if page[at] != "<":
            cut = page.find("<", at)
            cut = end if cut < 0 else cut
            yield "text", "", page[at:cut]
            at = cut
            continue
        if m := TAG.match(page, at):
            close, name, rest, at = m[1], m[2].lower(), m[3], m.end()
        elif page.startswith("<!--", at):
            cut = page.find("-->", at + 4)
            if cut < 0:
                return
            at = cut + 3
            continue
        elif page[at + 1 : at + 2] in ("!", "?"):
            cut = page.find(">", at)
            if cut < 0:
                return
            at = cut + 1
            continue
        elif ">" not in gone and (m := NAME.match(page, at)):
            # up to the first > that is not within a quoted value
            close, name, begin = "/" if page[at + 1] == "/" else "", m[1].lower(), m.end()
            cut = begin
            while (s := STEP.search(page, cut)) and s[0] == "=":
                cut = SPACE.match(page, s.end()).end()
                quote = page[cut : cut + 1]
                if quote in ("'", '"') and quote and quote not in gone:
                    after = page.find(quote, cut + 1)
                    if after < 0:
                        gone[quote] = True
                    cut = after + 1 if after >= 0 else cut
            if s is None:
                if page.find(">", begin) < 0:
                    gone[">"] = True
                yield "text", "", "<"
                at += 1
                continue
            rest, at = page[begin : s.start()], s.end()
        else:
            yield "text", "", "<"
            at += 1
            continue
        if close:
            yield "close", name, ""
            continue
        yield "open", name, rest
        if name in RAW:
            found = None if name in gone else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if found:
                at = found.end()
            elif name in TO_END:
                return
            else:
                gone[name] = True


def blocks(page: str | None) -> tuple[list[str], str]:
    """Text blocks in page order, and for each where it lies (OUT, IN, MAY_OUT, MAY_IN or TITLE).

    Blocks of navigation, headers, footers, sidebars, notices, adverts, forms and comments are left out; a header
    within an article keeps its headings, and a form that holds an article does not hide it. Unclosed and wrongly nested
    elements are ended as browsers do; but an element that is set aside and never ended hides its own text only, not the
    blocks that a browser would put into it.
    """
    out: list[tuple[str, str, int, bool]] = []  # text, place, innermost element that is set aside, whether directly in it
    held: list[str] = []
    # of each open element: name, 1 in the article, hint, element set aside (0: none), index of the last block-like element
    stack: list[tuple[str, int, int, int, int]] = []
    places: dict[str, list[int]] = {}
    hides: list[tuple[int, bool]] = [(0, False)]  # of each element set aside: the one around it, whether an article was begun within
    ended: set[int] = set()
    top = ("", 0, 0, 0, -1)
    heading = 0

    pending: list[tuple[int, int, tuple]] = []  # of inline elements set aside within the held text: where, which, and what is around

    def give(parts: list[str], around: tuple, direct: bool):
        if text := " ".join(htmllib.unescape("".join(parts)).split()):
            _, zone, hint, aside, _ = around
            out.append((text, (TITLE if heading and zone else IN if zone else OUT) if not hint else (MAY_IN if zone else MAY_OUT), aside, bool(aside) and direct))

    def flush():
        if held:
            direct = not any_block
            if pending:
                n, _, around = pending[0]
                give(held[:n], around, direct)
                del held[:n]
                pending.clear()
                direct = True
            give(held, top, direct)
            held.clear()

    any_block = False  # whether a block began since the innermost element set aside did

    def cut(k: int, whole: bool):
        """End the elements from k on; `whole` if the one at k has its end tag."""
        nonlocal top, heading
        flush()
        for i in range(len(stack) - 1, k - 1, -1):
            name, _, _, aside, _ = stack[i]
            places[name].pop()
            heading -= name in HEADING
            around = stack[i - 1][3] if i else 0
            if aside != around and (i == k and whole):
                ended.add(aside)
        del stack[k:]
        top = stack[-1] if stack else ("", 0, 0, 0, -1)

    for kind, tag, rest in tokens(page or ""):
        if kind == "text":
            held.append(rest)
            continue
        if tag == "br":
            held.append(" ")
            continue
        if kind == "close":
            if places.get(tag):
                k = places[tag][-1]
                if pending and k == len(stack) - 1 and pending[-1][1] == stack[k][3] and tag in INLINE:
                    n, aside, top = pending.pop()  # an inline element set aside ends within its block
                    held[n:] = [" "]
                    ended.add(aside)
                    places[tag].pop()
                    stack.pop()
                elif tag in INLINE and k == len(stack) - 1 and top[1:4] == (stack[k - 1][1:4] if k else (0, 0, 0)):
                    places[tag].pop()
                    stack.pop()
                    top = stack[-1] if stack else ("", 0, 0, 0, -1)
                else:
                    aside = top[3]
                    cut(k, True)
                    any_block = any_block or aside == top[3]
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW or tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        inline = tag in INLINE
        if not inline:
            flush()
            any_block = True
        if tag in ENDS_P and places.get("p") and places["p"][-1] > top[4]:
            cut(places["p"][-1], True)
        for name in SELF.get(tag, ()):
            if places.get(name) and places[name][-1] >= top[4]:
                cut(places[name][-1], True)
        _, zone, hint, aside, last = top
        mark = set_aside(tag, rest)
        begins = tag in MAIN or "role" in rest and bool(re.search(r"role\s*=\s*[\"']?main\b", rest, re.I))
        if begins and aside and stack and all(s[0] in ("form", "fieldset") or s[3] == (stack[i - 1][3] if i else 0) for i, s in enumerate(stack)):
            aside = 0  # a form around the article
        if mark == 2:
            if tag in HEADING and top[0] == "header":
                mark = 0 if set_aside("", rest) < 2 else 2
        if tag in HEADING and zone and top[0] == "header" and mark < 2 and aside and not hides[aside][0]:
            aside = hides[aside][0]  # the headings of an article's own header
        if mark == 2:
            hides.append((aside, False))
            aside = len(hides) - 1
            if inline:
                pending.append((len(held), aside, top))
            else:
                any_block = False
        elif inline and (zone, hint | (mark == 1), aside) != top[1:4]:
            flush()
        if begins and aside:
            k = aside
            while k and not hides[k][1]:
                hides[k] = hides[k][0], True
                k = hides[k][0]
        if not rest.endswith("/"):
            at = len(stack)
            top = tag, 1 if zone or begins else 0, 1 if hint or mark == 1 else 0, aside, last if inline or tag == "p" else at
            stack.append(top)
            places.setdefault(tag, []).append(at)
            heading += tag in HEADING
        elif mark == 2:
            ended.add(aside)
    cut(0, False)
    kept = []
    hidden = {0: False}
    for text, place, aside, direct in out:
        if aside not in hidden:  # an element that was ended hides all it holds, as does one around it
            k, chain = aside, []
            while k not in hidden:
                chain.append(k)
                k = hides[k][0]
            for j in reversed(chain):
                hidden[j] = hidden[hides[j][0]] or j in ended
        if not hidden[aside] and not direct:
            kept.append((text, place))
    return [t for t, _ in kept], "".join(z for _, z in kept)


#: Matching pairs of lines up to which a longest common subsequence is found pair by pair.
MATCHES = 1_000_000


def common(a: list[str], b: list[str]) -> set[int]:
    """Positions of a that lie on a longest common subsequence with b."""
    begin, n = 0, min(len(a), len(b))
    while begin < n and a[begin] == b[begin]:
        begin += 1
    tail = 0
    while tail < n - begin and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = {*range(begin), *range(len(a) - tail, len(a))}
    there = {*b[begin : len(b) - tail]}
    own = [i for i in range(begin, len(a) - tail) if a[i] in there]
    here = {a[i] for i in own}
    lines, other = [a[i] for i in own], [x for x in b[begin : len(b) - tail] if x in here]
    return out | {own[i] for i in _common(lines, other)}


def _common(a: list[str], b: list[str]) -> list[int]:
    """By chains of matching pairs (Hunt and Szymanski), unless lines repeat so often that halving a with rows of
    bits (Hirschberg, Hyyro) takes fewer steps."""
    where: dict[str, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    if sum(len(where.get(x, ())) for x in a) > MATCHES and len(a) > 1:
        half = len(a) // 2
        ahead, back = _lengths(a[:half], b), _lengths(a[:half - 1 : -1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: ahead[j] + back[j])
        return _common(a[:half], b[:cut]) + [half + i for i in _common(a[half:], b[cut:])]
    tails: list[int] = []
    last: list[tuple] = []
    for i, line in enumerate(a):
        for j in where.get(line, ()):
            k = bisect_left(tails, j)
            node = (i, last[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                last.append(node)
            else:
                tails[k], last[k] = j, node
    out, node = [], last[-1] if last else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """Lengths of the longest common subsequences of a and each beginning of b."""
    where: dict[str, int] = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for line in a:
        hit = row & where.get(line, 0)
        row = (row + hit | row - hit) & full
    out = [0]
    for bit in reversed(f"{row:0{len(b)}b}" if b else ""):
        out.append(out[-1] + (bit == "0"))
    return out


def _shared_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def main_text(lines: list[str], zones: str, near: list[str] | None) -> str:
    """The article's blocks, without what `near`, the nearest page with other lines, shares of the doubtful ones.

    Where no element holds an article, every line that the nearest page shares goes. Within an article those shared lines go
    that stand under a class or id with marks among other words. Lines that nothing marks stay: articles of a host
    share passages, and these are theirs.
    """
    inside = any(z in (IN, MAY_IN, TITLE) for z in zones)
    keep = [i for i, z in enumerate(zones) if z in (IN, MAY_IN, TITLE)] if inside else range(len(lines))
    if near is not None and near != lines and (not inside or MAY_IN in zones):
        drop = common(lines, near)
        keep = [i for i in keep if i not in drop or zones[i] in (IN, TITLE)]
    return "\n\n".join(lines[i] for i in keep)


#: Bytes of html that a range of neighbouring urls has, the most ranges (beyond it they grow), and sampled urls a range.
RANGE, RANGES, SAMPLE = 4 << 20, 32768, 16


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Pages are dealt by ranges of (host, path, url, id) of equal bytes, so a host of any size is split. A page with the same lines is no
    guide: consecutive pages of a host with equal lines are a run, and its pages meet the last page of the run before
    and the first page of the run after. Where such a page lies in another range, however far, a copy of it goes to the
    run's range; a first pass over the pages' digests finds these, at most two a range. Of the two, the page whose path
    shares the longer beginning is the nearest (ties: the earlier). Null html gives an empty text; a null url counts as
    empty; repeated rows each give a row; other columns are ignored.
    """
    spark = pages.sparkSession
    tune(spark)
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"), path.alias("path"))
    order = ["host", "path", "url", "page_id"]
    keys = rows.select("host", "path", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("page_id", F.lit(-1)).alias("page_id"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    parts = max(1, min(RANGES, n, (size or 0) // RANGE))
    sample = sorted(_key(r) for r in keys.sample(min(1.0, SAMPLE * parts / max(n, 1)), seed=5).collect())  # bounded by the number of ranges
    splits = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
    whole = ["part", "host", "path", F.coalesce("url", F.lit("")), F.coalesce("page_id", F.lit(-1)), "mark"]

    def brief(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, url, text, h, p in zip(*(b.column(i).to_pylist() for i in range(5))):
                out.append((bisect_right(splits, _key((h, p, url, page))), h, p, url, page, _mark(blocks(text)[0])))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), BRIEF_KINDS)], names=BRIEF)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each range the first page, the first page after its run, the last page, and the last page before its run."""
        part, seen = None, []
        last = before = None  # the last page so far, and the last page of the run before it

        def give():
            tail = [(2, last)] + ([(3, before)] if before else [])
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*((k, *x) for k, x in seen + tail)), (pa.int32(), *BRIEF_KINDS))], names=["kind", *BRIEF])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in BRIEF)):
                if row[0] != part:
                    if part is not None:
                        yield give()
                    part, seen, last, before, open_ = row[0], [(0, row)], None, None, True
                elif open_ and (row[1], row[5]) != (last[1], last[5]):
                    open_ = False
                    if row[1] == last[1]:
                        seen.append((1, row))
                if last is not None and (row[1], row[5]) != (last[1], last[5]):
                    before = last if row[1] == last[1] else None
                last = row
        if part is not None:
            yield give()

    briefs = rows.mapInArrow(brief, "part int, host string, path string, url string, page_id long, mark binary")
    briefs = briefs.repartition(parts, "part").sortWithinPartitions(*whole)
    ends: dict[int, dict[int, tuple]] = {}  # four rows a range at most
    for r in briefs.mapInArrow(edges, "kind int, part int, host string, path string, url string, page_id long, mark binary").collect():
        ends.setdefault(r.part, {})[r.kind] = (_key((r.host, r.path, r.url, r.page_id)), bytes(r.mark))
    also: dict[tuple, list[int]] = {}  # the pages that go to further ranges
    filled = sorted(ends)
    for k, part in enumerate(filled):
        for own, near, far, others in ((0, 2, 3, filled[:k][::-1]), (2, 0, 1, filled[k + 1 :])):
            key, mark = ends[part][own]
            for other in others:
                e = ends[other]
                if e[near][0][0] != key[0]:
                    break
                guide = e[near] if e[near][1] != mark else e.get(far)
                if guide:
                    also.setdefault(guide, []).append(part)
                if guide or e[own][0][0] != key[0]:
                    break

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, url, text, h, p in zip(*(b.column(i).to_pylist() for i in range(5))):
                lines, zones = blocks(text)
                key, mark = _key((h, p, url, page)), _mark(lines)
                out.append((bisect_right(splits, key), False, h, p, url, page, mark, lines, zones))
                out += [(part, True, *out[-1][2:]) for part in also.get((key, mark), ())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), KINDS)], names=NAMES)

    laid = rows.mapInArrow(parse, "part int, halo boolean, host string, path string, url string, page_id long, mark binary, lines array<string>, zones string")
    laid = laid.repartition(parts, "part").sortWithinPartitions(*whole)

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def give(out):
            texts = [t for *_, t in out]
            return pa.record_batch({"page_id": pa.array([r[0] for r in out], pa.int64()), "url": pa.array([r[1] for r in out], pa.string()), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

        def settle(left, run, right):
            """The texts of a run's pages by (path, lines) of the pages beside it, in batches."""
            lines, members = run[1], run[2]
            near, made, out, held = [x for x in (left, right) if x is not None], {}, [], 0
            for halo, path, url, page, zones in members:
                if halo:
                    continue
                best = max(near, key=lambda x: _shared_start(x[0], path), default=None)
                at = zones, best is right
                if at not in made:
                    made[at] = main_text(lines, zones, best and best[1])
                out.append((page, url, made[at]))
                held += len(made[at])
                if len(out) >= BATCH_ROWS or held > 1 << 24:
                    yield give(out)
                    out, held = [], 0
            if out:
                yield give(out)

        left = run = None  # (path, lines) of the page before the run; the run's tag, lines and pages
        for b in batches:
            for part, halo, host, path, url, page, mark, lines, zones in zip(*(b.column(c).to_pylist() for c in NAMES)):
                tag = part, host, mark
                if run is None or run[0] != tag:
                    same = run is not None and run[0][:2] == tag[:2]
                    if run is not None:
                        yield from settle(left, run, (path, lines) if same else None)
                    left = (run[2][-1][1], run[1]) if same else None
                    run = tag, lines, []
                run[2].append((halo, path, url, page, zones))
        if run is not None:
            yield from settle(left, run, None)

    return laid.mapInArrow(difference, "page_id long, url string, text string, n_chars long")


NAMES = ["part", "halo", "host", "path", "url", "page_id", "mark", "lines", "zones"]
KINDS = (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.string()), pa.string())
BRIEF = ["part", "host", "path", "url", "page_id", "mark"]
BRIEF_KINDS = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())


def _mark(lines: list[str]) -> bytes:
    """A digest of the lines, which hold no line ends."""
    return hashlib.blake2b("\n".join(lines).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _key(r) -> tuple:
    host, path, url, page = r
    return (host or "").encode(), (path or "").encode(), (url or "").encode(), -1 if page is None else page
