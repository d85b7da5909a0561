"""Main text of web pages: templates of hosts by equivalence classes, slots, element names and class words."""

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import functions as F

from barsight.session import cut_lineage

LEAST_PAGES = 5  # different pages of a host before it has a template
EVERYWHERE = 0.8  # share of them that hold a template token
OFTEN = 0.1  # share of them that hold a nested class
VARIES = 0.1  # different texts of a slot, as a share of the pages that fill it
LISTED = 100_000  # template rows that are broadcast at most
OPEN, CLOSE, TEXT = range(3)  # kinds of events on a page

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|noscript|template|iframe|svg|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<=\s)(hidden)(?=\s|$)")
BLOCKS = set(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SPACES = {"br", "td", "th"}
# what an opening tag ends: the tags it closes, and where the search stops
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
}
SCOPE = {"article", "aside", "body", "div", "footer", "form", "header", "li", "main", "nav", "section", "td", "th"}
CONTENT = {"html", "body", "main", "article"}  # what no class word rules out
OUTSIDE = set("aside button dialog footer form head menu nav".split())
OUTSIDE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OUTSIDE_WORDS = set(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies disqus disclaimer footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notification"
    " overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing"
    " sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)


def _opened(tag, attributes, parent):
    """(path, outside, in an article, whether a class word speaks against it) of an element."""
    path, outside, inner = parent
    label, weak = tag, False
    if attributes:
        words, hidden = [], False
        for name, a, b, c, bare in ATTRIBUTE.findall(attributes):
            value, name = a or b or c, (name or bare).lower()
            if name in ("class", "id"):
                words += re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())
                if name == "class" and value:
                    label = f"{tag}.{'.'.join(sorted(value.split()))}"
            elif name == "role":
                outside |= value.lower() in OUTSIDE_ROLES
            hidden |= name == "hidden" or (name == "aria-hidden" and value.lower() == "true")
            hidden |= name == "style" and "display:none" in value.replace(" ", "").lower()
        outside |= hidden
        weak = tag not in CONTENT and any(w in OUTSIDE_WORDS or (w == "header" and not inner) for w in words)
    if tag in OUTSIDE or (tag == "header" and not inner):
        outside = True
    return (f"{path}/{label}", outside, inner or tag in ("article", "main")), weak


def events(page):
    """[(kind, role, text, characters in links, outside, in an article)] in page order.

    An event opens or closes a block-level element, or is a block: the text between two block-level
    tags. Its role is the path of block-level elements down to it. Every element that is opened is
    closed, at the end of the page at the latest. Character references are decoded, white space
    becomes one space. For elements only kind and role are filled in.

    A class or id word is a weak sign. It rules out no html, body, main or article element, nor an
    element that holds main, all the articles of a page, or over half of the text that no tag,
    role attribute or hiding rules out.
    """
    out, parts = [], []
    stack = [("", ("", False, False))]
    roles = [("", False, False)]
    links, linked = 0, 0
    # weak signs that lie above: per open element, per open block-level element, per block, main and article
    marks, signs, marked, mains, articles = [()], [()], [], [], []
    number = 0

    def flush():
        nonlocal linked
        text = "".join(parts)
        parts.clear()
        text = " ".join((html.unescape(text) if "&" in text else text).split())
        if text:
            role, outside, inner = roles[-1]
            marked.append((len(out), signs[-1]))
            out.append((TEXT, role, text, min(linked, len(text)), outside, inner))
        linked = 0

    def pop(depth):
        nonlocal links
        while len(stack) > depth:
            name = stack.pop()[0]
            links -= name == "a"
            if name in BLOCKS:
                out.append((CLOSE, roles.pop()[0], "", 0, True, False))
                signs.pop()
        del marks[depth:]

    at = 0
    for m in TOKEN.finditer(page):
        start, end = m.span()
        if start > at:
            parts.append(page[at:start])
            if links:
                linked += start - at
        at = end
        ending, tag, attributes = m.group(2, 3, 4)
        if not tag:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if block:
            if parts:
                flush()
            linked = 0
        elif tag in SPACES:
            parts.append(" ")
        if ending:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    pop(depth)
                    break
            continue
        if block:
            closed, stop = ENDS.get(tag, ({"p"}, SCOPE))
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in closed:
                    pop(depth)
                    break
                if stack[depth][0] in stop:
                    break
        if tag in VOID or attributes.endswith("/"):
            continue
        links += tag == "a"
        state, weak = _opened(tag, attributes.strip(), stack[-1][1])
        if not block:
            state = (stack[-1][1][0], *state[1:])
        mark = marks[-1]
        if weak:
            mark, number = (*mark, number), number + 1
        if tag in ("main", "article") and not state[1]:
            (mains if tag == "main" else articles).append(set(mark))
        stack.append((tag, state))
        marks.append(mark)
        if block:
            roles.append(state)
            signs.append(mark)
            out.append((OPEN, state[0], "", 0, True, False))
        elif (state[1] or mark) and not (stack[-2][1][1] or marks[-2]):
            # an inline element that is outside: its text is a block of its own
            flush()
    if at < len(page):
        parts.append(page[at:])
    flush()
    pop(1)
    if not number:
        return out
    total, under = 0, [0] * number
    for place, mark in marked:
        if not out[place][4]:
            size = len(out[place][2])
            total += size
            for x in mark:
                under[x] += size
    strong = {x for x in range(number) if 2 * under[x] <= total}.difference(*mains)
    if articles:
        strong -= set.intersection(*articles)
    for place, mark in marked:
        if mark and not strong.isdisjoint(mark):
            out[place] = (*out[place][:4], True, out[place][5])
    return out


def blocks(page):
    """[(role, text, characters in links, outside, in an article)] in page order."""
    return [event[1:] for event in events(page) if event[0] == TEXT]


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1), F.lit("")))


def _hash(text):
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _tokens(batches):
    """Tokens of a page: its elements and its texts in their roles, with counts and first places."""
    for batch in batches:
        rows, hashes = [], {}
        for site, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = events(page or "")
            content, seen = _content(found), {}
            for place, (kind, role, text, *_) in enumerate(found):
                entry = seen.setdefault((role, text), [0, place, None])
                if kind != OPEN and entry[2] is None:
                    entry[2] = place
                entry[0] += kind != CLOSE
            for (role, text), entry in seen.items():
                if role not in hashes:
                    hashes[role] = _hash(role)
                rows.append((site, content, hashes[role], _hash(text) if text else 0, *entry))
        yield pa.record_batch([list(c) for c in zip(*rows)] if rows else [[] for _ in TOKEN_SCHEMA], schema=TOKEN_SCHEMA)


TOKEN_SCHEMA = pa.schema([("site", pa.string())] + [(c, pa.int64()) for c in ("content", "role", "text", "n", "place", "close")])
TOKEN_SQL = "site string, content long, role long, text long, n long, place long, close long"


def _content(found):
    return _hash("\n".join(text for _, _, text, _, outside, _ in found if not outside))


def classes(pages, url_col="url", html_col="html"):
    """Equivalence classes per host: tokens with one occurrence vector over the host's pages.

    A token is an element (its opening and its closing) or a text, both told apart by their role.
    Columns: site, role (hash), text (hash, 0 for an element), class, pages, total (pages of the host),
    members (elements or texts of the class, as the token is), place and close (mean of its first
    opening and closing). Pages whose blocks outside boilerplate are equal count once, so a group of
    copies doesn't look like a template. The vector of a token is the xor of a hash of (page,
    occurrences): combined before the shuffle, equal exactly for equal vectors. A token is listed if it
    is on enough pages; ``templates`` checks order and nesting.
    """
    tokens = pages.select(host(F.col(url_col)).alias("site"), F.col(html_col).alias("html")).mapInArrow(_tokens, TOKEN_SQL)
    # copies agree on what counts, so any of them stands for the group
    per_page = tokens.groupBy("site", "content", "role", "text").agg(
        F.max("n").alias("n"), F.min("place").alias("place"), F.min("close").alias("close")
    )
    per_page = cut_lineage(per_page)
    total = per_page.groupBy("site").agg(F.count_distinct("content").alias("total"))
    vectors = per_page.groupBy("site", "role", "text").agg(
        F.bit_xor(F.xxhash64("content", "n")).alias("vector"),
        F.count(F.lit(1)).alias("pages"),
        F.avg("place").alias("place"),
        F.avg("close").alias("close"),
    )
    often = vectors.join(total, "site").where((F.col("total") >= LEAST_PAGES) & (F.col("pages") >= OFTEN * F.col("total")))
    kind = F.col("text") != 0
    size = often.groupBy("site", "vector", kind.alias("kind")).agg(F.count(F.lit(1)).alias("members"))
    often = often.withColumn("kind", kind).join(size, ["site", "vector", "kind"]).drop("kind")
    return often.withColumnRenamed("vector", "class")


class Template:
    """The classes of a host; the borders of a class are its tokens in their order, openings and closings apart."""

    def __init__(self, tokens):
        of = {}
        self.rank, self.fixed, self.roles = {}, set(), {}
        self.worded = {t["role"] for t in tokens if t["text"]}
        for t in tokens:
            borders = of.setdefault(t["class"], [])
            self.rank[t["class"]] = (t["pages"], t["members"], t["class"])
            key = t["role"], t["text"]
            if t["text"]:
                borders.append((t["place"], TEXT, key))
                if t["pages"] >= EVERYWHERE * t["total"]:
                    self.fixed.add(key)
            else:
                borders += [(t["place"], OPEN, key), (t["close"], CLOSE, key)]
        self.order = {c: [(kind, *key) for _, kind, key in sorted(borders)] for c, borders in of.items()}
        self.at = {border: (c, i) for c, borders in self.order.items() for i, border in enumerate(borders)}

    def border(self, kind, role, text):
        """(border or None, whether it is a text of the template's own) of an event."""
        if kind != TEXT:
            if (kind, role) not in self.roles:
                self.roles[kind, role] = self.at.get((kind, _hash(role), 0)), False
            return self.roles[kind, role]
        if role not in self.roles:
            self.roles[role] = _hash(role)
        if self.roles[role] not in self.worded:
            return None, False
        token = self.roles[role], _hash(text)
        return self.at.get((TEXT, *token)), token in self.fixed

    def faults(self, found):
        """(tokens, classes) that break the template on a page.

        A token does if it is out of the order of its class, or on the page less often than others of its
        class, or a text inside a span of another class that lies in its own. A class does if its span overlaps that of a class of more pages, without
        lying in one gap of it or around it.
        """
        passed, count = [], {}
        for kind, role, text, *_ in found:
            border = self.border(kind, role, text)[0]
            if border:
                n = count.get(border, 0)
                passed.append((border, n))
                count[border] = n + 1
        most = {}
        for (c, _), n in count.items():
            most[c] = max(n, most.get(c, 0))
        wrong = {(c, i) for c, n in most.items() for i in range(len(self.order[c])) if count.get((c, i), 0) < n}
        # a border that stands behind a later one or before an earlier one
        for part, sign in ((passed, 1), (passed[::-1], -1)):
            last, moved = {}, False
            for (c, i), n in part:
                here = sign * (n * len(self.order[c]) + i)
                if here < last.get(c, here):
                    wrong.add((c, i))
                    moved = True
                else:
                    last[c] = here
            if not moved:
                break  # all in order, so backwards too
        tokens = {self.order[c][i][1:] for c, i in wrong}
        left = [b for b, _ in passed if not tokens or self.order[b[0]][b[1]][1:] not in tokens]
        first, last, crossed, spans = {}, {}, set(), []
        for c, i in count.keys() if not tokens else set(left):
            first[c], last[c] = min(i, first.get(c, i)), max(i, last.get(c, i))
        for c, i in left:
            if c in crossed:
                continue
            if i == first[c]:
                if last[c] > i:
                    spans.append(c)
                continue
            kind, *token = self.order[c][i]
            if kind == TEXT and spans[-1] != c:
                tokens.add(tuple(token))
                continue
            while spans[-1] != c:
                if self.rank[spans[-1]] > self.rank[c]:
                    crossed.add(c)
                    spans.remove(c)
                    break
                crossed.add(spans.pop())
            else:
                if i == last[c]:
                    spans.pop()
        return tokens, crossed

    def slots(self, found):
        """[(slot, event)] of the texts of a page that are not the template's own.

        A slot is the path down the tree: the class and the border passed last, of all spans around, so
        that a class has slots of its own in each gap.
        """
        spans, out = [], []
        for event in found:
            border, own = self.border(*event[:3])
            if event[0] == TEXT and not own:
                out.append((tuple(spans), event))
            if not border:
                continue
            c, i = border
            for at in range(len(spans) - 1, -1, -1):
                if spans[at][0] == c:
                    if i == len(self.order[c]) - 1:
                        del spans[at]
                    else:
                        spans[at] = border
                    break
            else:
                if i == 0 and len(self.order[c]) > 1:
                    spans.append(border)
        return out


TEMPLATE = ("role", "text", "class", "place", "close", "pages", "total", "members")


def _by_site(pages, tokens, *columns):
    """Pages beside the tokens of their host. A host lists at most 1 / ``OFTEN`` times the tokens of a page."""
    known = cut_lineage(tokens.groupBy("site").agg(F.collect_list(F.struct(*TEMPLATE)).alias("tokens")))
    if known.count() <= LISTED:
        known = F.broadcast(known)
    return pages.join(known, "site", "left").select(*columns, "site", "html", "tokens")


def _with_templates(batch, known):
    """(site, template or None, events) of each page."""
    tokens = batch.column("tokens")
    for i, (site, page) in enumerate(zip(batch.column("site").to_pylist(), batch.column("html").to_pylist())):
        if site not in known:
            if len(known) >= 1000:
                known.clear()
            known[site] = Template(tokens[i].as_py()) if tokens[i].is_valid else None
        yield site, known[site], events(page or "")


def _faults(batches):
    known, told = {}, set()
    for batch in batches:
        rows = set()
        for site, template, found in _with_templates(batch, known):
            if template:
                tokens, crossed = template.faults(found)
                rows.update((site, None, role, text) for role, text in tokens)
                rows.update((site, c, None, None) for c in crossed)
        rows -= told
        told = told | rows if len(told) < 100_000 else rows
        schema = pa.schema([("site", pa.string()), ("class", pa.int64()), ("role", pa.int64()), ("text", pa.int64())])
        yield pa.record_batch([list(c) for c in zip(*rows)] if rows else [[] for _ in schema], schema=schema)


def templates(pages, url_col="url", html_col="html"):
    """The valid classes: columns as of ``classes``, one row per token.

    Classes are checked on every page of their host. Tokens that are out of their class's order or its gaps
    on some page, and all tokens of a class that isn't nested with those of more pages, stand alone, as a
    class of one token is always in order and nested. The classes left form the template's tree: a class
    lies in the gap of another one between two of its borders, or in none.
    """
    found = cut_lineage(classes(pages, url_col, html_col))
    rows = pages.select(host(F.col(url_col)).alias("site"), F.col(html_col).alias("html"))
    faults = _by_site(rows, found, "site").select("site", "html", "tokens").where("tokens is not null")
    faults = cut_lineage(faults.mapInArrow(_faults, "site string, class long, role long, text long").distinct())
    moved = faults.where("role is not null").select("site", "role", "text", F.lit(True).alias("moved"))
    crossed = faults.where("role is null").select("site", "class", F.lit(True).alias("crossed"))
    found = found.join(moved, ["site", "role", "text"], "left").join(crossed, ["site", "class"], "left")
    alone = F.coalesce("moved", "crossed", F.lit(False))
    found = found.withColumn("class", F.when(alone, F.xxhash64("role", "text")).otherwise(F.col("class")))
    return found.withColumn("members", F.when(alone, F.lit(1)).otherwise(F.col("members"))).drop("moved", "crossed")


def main_text(page, container=None):
    """Blocks of one page's main text, joined by blank lines, by the page alone."""
    left = [b for b in blocks(page) if not b[3]]
    if any(b[4] for b in left):
        left = [b for b in left if b[4]]
    else:
        left = [b for b in left if 2 * b[2] <= len(b[1])]
        left = [b for b in left if container and (b[0] == container or b[0].startswith(container + "/"))] or left
    return "\n\n".join(b[1] for b in left)


BLOCK = pa.struct([("slot", pa.int64()), ("text", pa.string()), ("linked", pa.bool_()), ("inner", pa.bool_())])
PART = pa.struct([("slot", pa.int64()), ("role", pa.string()), ("inner", pa.bool_()), ("text", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())])
CUT_SQL = """id long, url string, site string, content long, blocks array<struct<slot: long, text: string, linked: boolean, inner: boolean>>,
    parts array<struct<slot: long, role: string, inner: boolean, text: long, chars: long, linked: long>>"""


def _lists(rows, kind):
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    flat = list(zip(*(x for r in rows for x in r))) or [[] for _ in kind]
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(flat, kind)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _cut(batches):
    known = {}
    for batch in batches:
        contents, every, parts, names = [], [], [], {}
        for _, template, found in _with_templates(batch, known):
            rows, here = [], {}
            texts = template.slots(found) if template else [((), e) for e in found if e[0] == TEXT]
            for slot, (_, role, text, linked, outside, inner) in texts:
                if outside:
                    continue
                name = slot, role, inner
                if name not in names:
                    names[name] = _hash(f"{slot} {role} {inner}")
                rows.append((names[name], text, 2 * linked > len(text), inner))
                if template:
                    part = here.setdefault(name, [[], 0, 0])
                    part[0].append(text)
                    part[1] += len(text)
                    part[2] += linked
            if any(r[3] for r in rows):  # nothing else of the page is taken then
                rows = [r for r in rows if r[3]]
            contents.append(_content(found))
            every.append(rows)
            parts.append([(names[n], n[1], n[2], _hash("\n".join(t)), *sizes) for n, (t, *sizes) in here.items()])
        yield pa.record_batch(
            {
                "id": batch.column("id"), "url": batch.column("url"), "site": batch.column("site"),
                "content": pa.array(contents, pa.int64()), "blocks": _lists(every, BLOCK), "parts": _lists(parts, PART),
            }
        )


def main_slots(cut):
    """One row per host: ``main``, the slots of the text on pages without an article, and ``same``, those never taken.

    A slot is main if its text varies over the pages, is not mostly links and stands under the
    container: the element right under which most text of such slots stands. A slot in an article is
    left out if enough pages fill it and all with one text. Copies of a page count once.
    """
    parts = cut.select("site", "content", F.explode("parts").alias("p")).select("site", "content", "p.*")
    once = parts.groupBy("site", "slot", "role", "inner", "content").agg(
        F.min("text").alias("text"), F.max("chars").alias("chars"), F.max("linked").alias("linked")
    )
    slots = once.groupBy("site", "slot", "role", "inner").agg(
        F.count(F.lit(1)).alias("pages"), F.count_distinct("text").alias("kinds"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    slots = cut_lineage(slots)
    same = (F.col("pages") >= LEAST_PAGES) & (F.col("kinds") == 1)
    texts = slots.where(~same & ~F.col("inner") & (F.col("kinds") >= VARIES * F.col("pages")) & (2 * F.col("linked") <= F.col("chars")))
    parent = F.regexp_replace("role", "/[^/]*$", "")
    container = (
        texts.groupBy("site", parent.alias("parent"))
        .agg(F.sum(F.col("chars") - F.col("linked")).alias("plain"))
        .groupBy("site")
        .agg(F.max_by("parent", F.struct("plain", "parent")).alias("container"))
    )
    under = (F.col("role") == F.col("container")) | F.col("role").startswith(F.concat("container", F.lit("/")))
    main = texts.join(container, "site").where(under).groupBy("site").agg(F.collect_list("slot").alias("main"))
    return main.join(slots.where(same & F.col("inner")).groupBy("site").agg(F.collect_list("slot").alias("same")), "site", "full")


def extract(pages, id_col="page_id", url_col="url", html_col="html"):
    """One row per page: id, url, text, n_chars.

    The host's template is the tree of its valid equivalence classes (``templates``). Its own texts,
    if on nearly all pages, go, and what is left of a page lies in its slots, the gaps between the
    borders of a class. Boilerplate is also what stands in elements named or labelled as menus,
    headers, footers, sidebars, notices, adverts, forms or comments. On pages with an article (or
    main) element the text is what its slots hold, but those that hold one text on all pages; on
    others what the host's main slots hold (``main_slots``). Hosts with fewer than five different
    pages have no template: their text is that of ``main_text``.

    Null html or url is empty; pages without a host share one group. Empty pages give an empty text.
    Repeated rows give repeated results. Other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host(F.col(url_col)).alias("site")
    )
    cut = cut_lineage(_by_site(rows, templates(pages, url_col, html_col), "id", "url").mapInArrow(_cut, CUT_SQL))
    chosen = cut_lineage(main_slots(cut))
    if chosen.count() <= LISTED:
        chosen = F.broadcast(chosen)
    none = F.array().cast("array<bigint>")
    out = cut.join(chosen, "site", "left").withColumns({"main": F.coalesce("main", none), "same": F.coalesce("same", none)})
    out = out.withColumn("under", F.filter("blocks", lambda b: F.array_contains("main", b["slot"]) & ~b["linked"]))
    kept = (
        F.when(F.exists("blocks", lambda b: b["inner"]), F.filter("blocks", lambda b: ~F.array_contains("same", b["slot"])))
        .when(F.size("under") > 0, F.col("under"))
        .otherwise(F.filter("blocks", lambda b: ~b["linked"]))
    )
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n")
    return out.select(F.col("id").alias(id_col), "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
