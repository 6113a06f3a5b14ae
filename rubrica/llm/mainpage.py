"""Main text of web pages by line-block distribution.

Markup is cut into lines at block elements. A line's weight is the length of its text outside links (0 if half of it is links); lines
within menus, headers, footers, sidebars, notices, adverts, forms and comment sections (by element, role,
class or id) weigh nothing and are never kept. Classes that tell of layout only (widget, sidebar, related, ...) do not count on an element that
names itself content as well, nor for a marked article inside it. Weights are summed over sliding windows of lines. A
run starts at a surge (a window sum that leaves zero and reaches the threshold) and ends at a dive (a window of no
weight); lines outside the runs are not kept. Dropped lines are no distance: windows and runs reach across them.

The heaviest run names the container (the innermost one of CONTAINERS around all its lines), and every run in it that
surges is kept, with the short ones between them; if no window reaches SURGE, any text surges. Where the page marks its
article (article, or main without one), the edges of the mark are dives and the mark is a weight: text inside counts
MARKED times. If the heaviest run lies inside, the marked lines are the text, lists of links among them too; if
unmarked text outweighs it nevertheless (a mark around links or a stub), the runs outside it are. An article of links
alone has no run and stays whole unless a run outside surges.

Defined results: a null, empty or textless page has empty text and 0 characters; unclosed elements end with their
parent or at the next block; repeated rows give a row each; an empty table gives no rows; extra columns are
ignored; html of any length is read whole.
"""

from __future__ import annotations

import html
import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from rubrica.llm.common import slices, table

WINDOW, SURGE, MARKED = 3, 40, 8
# Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div html main td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math object xmp noembed noframes".split())
DROPPED = RAW | frozenset("nav header footer aside form button select option menu dialog fieldset label head audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|comments?|commentlist|disqus|respond|replies|sidebar|side-bar|widget\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notice|notification|alert|popup|modal|newsletter|subscribe|social|share|sharing|related|recommended|pagination|pager|skip-link|toolbar|login|signup)(?:$|[\s_-])",
    re.I,
)
#: Classes that no content has, whatever else an element names itself.
FOREIGN = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|comments?|commentlist|disqus|respond|replies|cookies?|consent|gdpr|popup|modal|login|signup)(?:$|[\s_-])", re.I)
CONTENT = re.compile(r"^(?:(?:page|post|entry|article|main|site|story|the)[_-]?)?(?:content|article|post|entry|main|story|body|text)(?:[_-]?(?:content|body|text|area|wrapper))?$", re.I)
SOFT, HARD = 1, 2
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|([^\s=\"'<>/]+)")
SPACE = re.compile(r"\s+")


def attributes(raw: str) -> dict[str, str]:
    return {(m[1] or m[3]).lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(raw)}


def unwanted(name: str, raw: str, depth_in_article: bool) -> int:
    """0, SOFT (by a class of layout) or HARD."""
    if name == "header" and depth_in_article:
        return 0
    if name in DROPPED:
        return HARD
    if not raw.strip():
        return 0
    got = attributes(raw)
    if "hidden" in got or got.get("aria-hidden") == "true" or got.get("role", "").lower() in ROLES:
        return HARD
    names = [got.get(k, "") for k in ("class", "id")]
    found = [m[0].strip(" _-\t\n").lower() for n in names for m in UNWANTED.finditer(n)]
    if not any(w != "header" or not depth_in_article for w in found):
        return 0
    if any(FOREIGN.search(n) for n in names):
        return HARD
    return 0 if any(CONTENT.match(token) for n in names for token in n.split()) else SOFT


def lines_of(page: str) -> list[tuple[str, int, bool, bool, tuple[int, ...]]]:
    """(text, link characters, kept, inside a marked article, open containers) of each line."""
    lines: list[tuple[str, int, bool, bool, tuple[int, ...]]] = []
    stack: list[tuple[str, int]] = []
    counts: dict[str, int] = {}  # open elements of each name
    blocks: list[int] = []  # places of the blocks in the stack
    outer: list[int] = []  # what the layout around each open article said
    opened: list[tuple[int, int]] = []  # place in the stack and number of each open container
    text: list[str] = []
    linked = numbers = 0
    hard = soft = marked = links = 0

    def flush() -> None:
        nonlocal linked
        joined = SPACE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            within = opened[:-1] if opened and opened[-1][0] == len(stack) - 1 else opened  # a div that holds only this line is its block
            lines.append((joined, linked, not hard and not soft, marked > 0, tuple(number for _, number in within)))
        text.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal hard, soft, marked, links
        while len(stack) > upto:
            name, bad = stack.pop()
            if opened and opened[-1][0] == len(stack):
                opened.pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            counts[name] -= 1
            hard -= bad == HARD
            soft -= bad == SOFT
            if name in ("article", "main"):
                marked -= 1
                soft = outer.pop()
            links -= name == "a"

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if links:
                linked += len(piece.strip())

    at, close_last = 0, page.rfind(">")
    while at < len(page):
        m = TOKEN.search(page, at) if at <= close_last or page.find("<!--", at) >= 0 else None
        if not m:
            rest = page[at:]
            add(rest if not re.match(r"<[a-zA-Z/]", rest[rest.find("<") :] if "<" in rest else "") else rest[: rest.find("<")])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if m[1]:  # a closing tag ends what is open inside it; one that matches nothing is ignored
            if not counts.get(name):
                if name in BLOCKS:
                    flush()
                continue
            open_at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)  # all above it are closed with it
            if blocks and blocks[-1] >= open_at:
                flush()
            close(open_at)
            continue
        if name in BLOCKS:
            flush()
            ended = ("p", "li", "dt", "dd", "option") if name in ("li", "dt", "dd", "option") else ("p",)
            if blocks and stack[blocks[-1]][0] in ended:  # a block ends an open paragraph and its inline elements
                close(blocks[-1])
        if name in VOID:
            continue
        bad = unwanted(name, m[3], marked > 0)
        if name in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in CONTAINERS:
            numbers += 1
            opened.append((len(stack), numbers))
        if name in BLOCKS:
            blocks.append(len(stack))
        if name in ("article", "main"):
            marked += 1
            outer.append(soft)
            soft = 0
        stack.append((name, bad))
        counts[name] = counts.get(name, 0) + 1
        hard += bad == HARD
        soft += bad == SOFT
        links += name == "a"
    flush()
    return lines


def surges(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int, int]]:
    """(first, end, weight) of the runs between surge and dive points of the window sums."""
    n, runs = len(weights), []
    sums = [sum(weights[i : i + window]) for i in range(n)]
    i = 0
    while i < n:
        if not sums[i]:
            i += 1
            continue
        first, peak = i, 0
        while i < n and sums[i]:
            peak = max(peak, sums[i])
            i += 1
        if peak >= surge:
            while not weights[first]:  # the windows before the surge reach into it
                first += 1
            end = i
            while not weights[end - 1]:
                end -= 1
            runs.append((first, end, sum(weights[first:end])))
    return runs


def shared(paths: list[tuple[int, ...]]) -> tuple[int, ...]:
    """The containers that all lines are in."""
    low, high = min(paths), max(paths)
    return low[: next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))]


def weights_of(lines: list[tuple]) -> list[int]:
    return [len(t) - linked if linked < 0.5 * len(t) else 0 for t, linked, *_ in lines]


def marked_wins(lines: list[tuple]) -> bool:
    """Whether the heaviest run of the page lies inside a marked article."""
    inside = outside = 0
    for marked, part in itertools.groupby(lines, key=lambda line: line[3]):
        weights = weights_of(list(part))
        if marked:
            inside = max([inside, *(w for *_, w in surges(weights, WINDOW, 1))])
        else:
            outside = max([outside, *(w for *_, w in surges(weights, WINDOW, SURGE))])
    return MARKED * inside >= outside


def main_text(page: str | None) -> str:
    if not page:
        return ""
    lines = [line for line in lines_of(page) if line[2]]
    if any(line[3] for line in lines):
        if marked_wins(lines):
            return "\n".join(line[0] for line in lines if line[3])
        lines = [line for line in lines if not line[3]]
    weights = weights_of(lines)
    surged = surges(weights, WINDOW, SURGE) or surges(weights, WINDOW, 1)
    if not surged:
        return ""
    paths = [line[4] for line in lines]
    first, end, _ = max(surged, key=lambda r: (r[2], -r[0]))
    inside = shared(paths[first:end])
    within = lambda r: all(p[: len(inside)] == inside for p in paths[r[0] : r[1]])
    reach = [r for r in surged if within(r)]
    runs = [r for r in surges(weights, WINDOW, 1) if reach[0][0] <= r[0] and r[1] <= reach[-1][1] and within(r)]
    return "\n".join(lines[i][0] for first, end, _ in runs for i in range(first, end))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "html")):
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
