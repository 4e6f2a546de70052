"""Metadata of a page's tree: meta tags, OpenGraph, JSON-LD, rules on elements, media, licence.

Plain Python on one page; `operators.dom` runs it on Arrow batches. What sources say is collected first,
each field then takes the first source of its order of precedence. No network access: rules that need
an HTTP call are left out.
"""

from __future__ import annotations

import datetime
import html
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pagelathe.functions import vocab
from pagelathe.functions.names import byline, joined, split_names
from pagelathe.functions.tree import Indexed, Node, parse, unescape

_SPACE = re.compile(r"\s+")
_SITE = re.compile(r"https?://[^/]+")
#: The field that a meta tag of some name speaks for.
_SPEAKS = {
    **dict.fromkeys(vocab.TITLE_NAMES, "title"), **dict.fromkeys(vocab.DESCRIPTION_NAMES, "description"), **dict.fromkeys(vocab.AUTHOR_NAMES, "author"),
    **dict.fromkeys(vocab.PUBLISHER_NAMES, "sitename"), **dict.fromkeys(vocab.APPLICATION_NAMES, "application"), **dict.fromkeys(vocab.TAG_NAMES, "tags"), "twitter:url": "url",
}
_SPEAKS_PROPERTY = {"article:tag": "tags", "author": "author", "article:author": "author", "article:publisher": "sitename"}
_SPEAKS_ITEM = {"author": "author", "description": "description", "headline": "title"}
_ARTICLES, _PUBLISHERS = frozenset(vocab.ARTICLE_TYPES), frozenset(vocab.PUBLISHER_TYPES)


def trim(s: str | None) -> str | None:
    return None if s is None else _SPACE.sub(" ", s).strip()


def clean(s: str | None) -> str | None:
    """Unescaped, printable, trimmed and capped; blank gives None."""
    if s is None:
        return None
    if len(s) > vocab.LONGEST_VALUE:
        s = s[: vocab.LONGEST_VALUE - 1] + "…"
    s = unescape(s)
    if not s.isprintable():
        s = "".join(c for c in s if c.isprintable() or c.isspace())
    return trim(s) or None


# Marked elements


def _tokens(n: Node, name: str) -> list[str]:
    return (n.get(name) or "").split()


def marked(root: Node, marks: dict) -> Iterator[list[Node]]:
    """The elements of each kind of mark, from the most explicit kind to the loosest."""
    for kind, told in marks.items():
        if kind == "tag":
            yield list(root.iter(*told))
        elif kind == "inside":
            tags, words = told
            yield [n for n in root.iter(*tags) if any(w in (n.get(a) or "").lower() for w in words for a in ("class", "id"))]
        else:
            yield [n for n in root.having(kind) if any(t in told for t in _tokens(n, kind))]


def first_text(root: Node, marks: dict, below: int) -> str | None:
    """The first text of fewer than `below` characters that a marked element holds."""
    texts = (n.all_text() for nodes in marked(root, marks) for n in nodes)
    return next((trim(t) for t in texts if t.strip() and len(t) < below), None)


def split_tags(told: str) -> list[str]:
    """Parts between the first kind of separator that occurs."""
    m = re.search(vocab.TAG_SEPARATORS, told)
    return [t for t in map(trim, told.split(m[0]) if m else [told]) if t]


def linked(root: Node, marks: dict, path: str) -> list[str]:
    """Texts of the links to `path` that are marked elements or stand in one, of the first kind of mark that has any."""
    if not any(path in (a.get("href") or "") for a in root.iter("a")):
        return []
    for nodes in marked(root, marks):
        links = {id(a): a for n in nodes for a in n.iter("a") if path in (a.get("href") or "")}
        if links:
            return [t for a in links.values() for t in split_tags(trim(a.all_text()))]
    return []


# Meta tags


@dataclass
class Said:
    """What the meta tags of a page say, by field."""

    graph: dict[str, str] = field(default_factory=dict)
    first: dict[str, str] = field(default_factory=dict)
    authors: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    dates: dict[str, str] = field(default_factory=dict)
    sites: list[str] = field(default_factory=list)


def meta_tags(root: Node) -> Said:
    """OpenGraph values hold over named ones, of which the first counts; authors and tags add up.

    Where OpenGraph states title, author, address, description and site, nothing else is read. Tags in the
    body speak for parts of the page (comments, related articles), so those of the head alone count.
    """
    said = Said()
    tags = [(n, n.get("content")) for head in root.iter("head") for n in head.iter("meta") if n.get("content")]
    if not tags:
        return said
    for n, content in tags:
        name = n.get("property") or ""
        if name.startswith("og:"):
            said.graph[name[3:]] = content
        for word in ("property", "name", "itemprop"):
            said.dates.setdefault((n.get(word) or "").lower(), content)
        if (n.get("property") or n.get("name") or "").startswith(("og:", "twitter:")) and (m := _SITE.match(content)):
            said.sites.append(m[0])
    graph = said.graph
    told = {"title": graph.get("title"), "author": graph.get("author") or graph.get("article:author"), "url": graph.get("url"), "description": graph.get("description"), "sitename": graph.get("site_name")}
    if told["url"] and not sound(told["url"]):
        told["url"] = None
    said.first = {k: trim(v) for k, v in told.items() if v and trim(v)}
    if len(said.first) == len(told):
        return said
    said.authors = said.first["author"].split("; ") if "author" in said.first else []
    for n, content in tags:
        if n.get("property"):
            what = _SPEAKS_PROPERTY.get(n.get("property"))
        elif n.get("name"):
            name = n.get("name").lower()
            what = _SPEAKS.get(name) or ("application" if "twitter:app:name" in name else None)
        else:
            what = _SPEAKS_ITEM.get(n.get("itemprop") or "")
        if what == "author":
            said.authors = joined(said.authors, split_names(content))
        elif what == "tags":
            said.tags += split_tags(re.sub("[\"']", "", trim(html.unescape(content))))
        elif what == "application":
            said.first[what] = content  # the last of them
        elif what and (what != "url" or sound(content)):
            said.first.setdefault(what, content)
    if said.authors:
        said.first["author"] = "; ".join(said.authors)
    if "application" in said.first:
        said.first.setdefault("sitename", said.first["application"])
    return said


# JSON-LD


def _kind(x: dict) -> str:
    t = x.get("@type")
    t = t[0] if isinstance(t, list) and t else t
    return t.lower() if isinstance(t, str) else ""


def _listed(x) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def json_objects(root: Node) -> Iterator[dict]:
    """Objects of all schema.org scripts, @graph and live blogs unwrapped; of broken scripts what can still be read."""
    for node in root.iter("script"):
        if (node.get("type") or "").split(";")[0].strip().lower() != "application/ld+json":
            continue
        text = node.all_text()
        try:
            held = _listed(json.loads(text))
        except ValueError:
            yield broken_json(text)
            continue
        for x in held:
            if not isinstance(x, dict) or not isinstance(x.get("@context"), str) or not x["@context"].rstrip("/").lower().endswith("schema.org"):
                continue
            inner = x.get("@graph") or (x.get("liveBlogUpdate") if _kind(x) == "liveblogposting" else None)
            yield from (y for y in (_listed(inner) if inner else [x]) if isinstance(y, dict))


def _unescaped(s: str) -> str:
    """A JSON string's text, if its escapes are sound."""
    try:
        return json.loads(f'"{s}"', strict=False)
    except ValueError:
        return s


def broken_json(text: str) -> dict:
    """An article with what single expressions find in JSON that does not parse."""
    told = r'"((?:[^"\\]|\\.)+)'
    value = lambda key: (m := re.search(rf'"{key}"\s*:\s*{told}', text)) and _unescaped(m[1])
    people = map(_unescaped, re.findall(rf'"(?:author|person)"\s*:[^}}\]]*?"name"\s*:\s*{told}', text, re.I))
    return {"@type": "Article", "headline": value("headline"), "articleSection": value("articleSection"), "author": [{"name": p} for p in people]}


def _person(x) -> list[str]:
    """The names that an author entry states: a text, JSON in a text, a name, a list of names, or name parts."""
    if isinstance(x, str):
        if x.lstrip().startswith(("{", "[")):
            try:
                return [n for y in _listed(json.loads(x)) for n in _person(y)]
            except ValueError:
                pass
        return [x]
    if not isinstance(x, dict) or x.get("@type", "Person") not in ("Person", ["Person"]):
        return []
    name = x.get("name")
    if name is None:
        parts = [x.get(k) for k in ("givenName", "additionalName", "familyName")]
        return [" ".join(p for p in parts if isinstance(p, str))] if x.get("givenName") and x.get("familyName") else []
    return [n for n in _listed(name) if isinstance(n, str)]


def _better_site(now: str | None, told, kind: str) -> str | None:
    """A publisher's name replaces none, a shorter one, or an address."""
    if not isinstance(told, str) or not told:
        return now
    longer = now is not None and len(now) < len(told) and kind != "webpage"
    address = now is not None and now.startswith("http") and not told.startswith("http")
    return told if now is None or longer or address else now


def from_json(objects: Iterable[dict], site: str | None = None) -> dict:
    """name, title, categories, sitename and rawDate as far as the objects state them."""
    out: dict = {"sitename": site}
    names: list[str] = []
    for x in objects:
        kind = _kind(x)
        publisher = x.get("publisher")
        if isinstance(publisher, dict) and isinstance(publisher.get("name"), str):
            out["sitename"] = publisher["name"]
        if kind in _PUBLISHERS:
            for key in ("name", "alternateName"):
                out["sitename"] = _better_site(out["sitename"], x.get(key), kind)
        elif kind == "person":
            names = joined(names, [n for told in _person({"name": x.get("name")}) for n in split_names(told)])
        elif kind in _ARTICLES:
            names = joined(names, [n for a in _listed(x.get("author")) for told in _person(a) for n in split_names(told)])
            sections = [s for s in _listed(x.get("articleSection")) if isinstance(s, str) and s]
            if sections:
                out.setdefault("categories", sections)
            title = x.get("name") if kind == "article" and x.get("name") else x.get("headline")
            if isinstance(title, str):
                out.setdefault("title", title)
            if isinstance(x.get("datePublished"), str):
                out.setdefault("rawDate", x["datePublished"])
    if names:
        out["name"] = "; ".join(names)
    return out


# Single fields


def title(root: Node) -> str | None:
    """A sole h1, a marked element, the title without its last suffix, the first h1 or h2."""
    heads = [t for n in root.iter("h1") if (t := trim(n.all_text()))]
    if len(heads) == 1:
        return heads[0]
    if found := first_text(root, vocab.TITLE_MARKS, 200):
        return found
    told = next((t for n in root.iter("title") if (t := trim(n.all_text()))), None)
    if told:
        cut = max(told.rfind(" - "), told.rfind(" | "))
        return told[:cut] if cut > 0 else told
    return next(iter([*heads, *(t for n in root.iter("h2") if (t := trim(n.all_text())))]), None)


def site_from_title(root: Node) -> str | None:
    """What stands after the first separator in the title."""
    told = next((t for n in root.iter("title") if (t := trim(n.all_text()))), "")
    m = re.search(r"[-|]\s+(.*)$", told)
    return m[1] if m else None


def author(root: Node) -> str | None:
    """A marked element, or a byline in running CJK text."""
    if found := first_text(root, vocab.AUTHOR_MARKS, 75):
        return byline(found)
    # Every pattern has characters beyond ASCII.
    texts = [n.text for n in root.iter() if not n.text.isascii() and n.tag not in ("script", "style")]
    for pattern in vocab.CJK_BYLINES if texts else ():
        for text in texts:
            if m := re.search(pattern, text):
                return m[0]
    return None


def check_authors(names: str | None, blocked: Iterable[str] = vocab.BLOCKED_AUTHORS) -> str | None:
    """Names without the blocked ones, whatever their case."""
    lower = {b.lower() for b in blocked}
    kept = [a for a in map(str.strip, (names or "").split(";")) if a and a.lower() not in lower]
    return "; ".join(kept) or None


def licence(root: Node) -> str | None:
    """From links marked as licence, by address or else text; from links in footers only Creative Commons."""
    marked = ((a, None) for a in root.iter("a") if a.get("rel") == "license")
    feet = (n for n in root.iter("footer", "div") if n.tag == "footer" or "footer" in (n.get("class") or "") or "footer" in (n.get("id") or ""))
    for a, text in [*marked, *((a, vocab.LICENCE_TEXT) for n in feet for a in n.iter("a"))]:
        if a.get("href") is None:
            continue
        if m := re.search(vocab.LICENCE_PATH, a.get("href")):
            return f"CC {m[1].upper()} {m[2]}"
        m = re.search(text or r"\S.*", trim(a.text))
        if m:
            return m[0]
    return None


def sound(u: str) -> bool:
    """http or https and a host of some length."""
    m = re.match(r"https?://([^/?#]*)", u)
    return bool(m) and len(m[1]) >= 5 and not (m[1].startswith("www.") and len(m[1]) < 8)


def url(root: Node, said: Said, default: str | None) -> str | None:
    """Stated by a meta tag; canonical; of the default language; or the address the page came from."""
    if "url" in said.first:
        return said.first["url"]
    links = [(n.get("rel"), n.get("hreflang"), n.get("href")) for n in root.iter("link") if re.match(r"https?://|/", n.get("href") or "")]
    canonical = [h for rel, _, h in links if rel == "canonical"]
    neutral = [h for rel, lang, h in links if rel == "alternate" and lang == "x-default"]
    got = next(iter([*canonical, *neutral]), default)
    if got and got.startswith("/") and said.sites:
        got = said.sites[0] + got
    return got if got and sound(got) else None


def domain(u: str | None) -> str | None:
    """The registered domain in lower case: two labels, three below a country's second level; none for numbers and bare names."""
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", u or "", re.I)
    labels = m[1].lower().split(".") if m else []
    if len(labels) < 2 or labels[-1].isdigit():
        return None
    keep = 3 if len(labels[-1]) == 2 and labels[-2] in vocab.SECOND_LEVEL else 2
    return ".".join(labels[-keep:])


def site_name(told: str | None, address: str | None) -> str | None:
    """The stated name, without @ and in title case if it is one lower-case word; else the host."""
    if told:
        told = told.lstrip("@")
        return told.title() if "." not in told and not told[:1].isupper() else told
    m = re.match(r"https?://(?:www\.|w[0-9]+\.)?([^/]+)", address or "")
    return m[1] if m else None


def raw_date(root: Node, said: Said) -> str | None:
    """From a meta tag, or the first time element."""
    stated = (said.dates[n] for n in vocab.DATE_NAMES if n in said.dates)
    shown = (t for n in root.iter("time") if (t := n.get("datetime") or trim(n.all_text())))
    return next(stated, None) or next(shown, None)


def shown_date(root: Node) -> str | None:
    """The first short text with a digit that an element marked as the date holds."""
    texts = (trim(n.all_text()) for nodes in marked(root, vocab.DATE_MARKS) for n in nodes)
    return next((t for t in texts if len(t) < 60 and any(c.isdigit() for c in t)), None)


def address_date(u: str | None) -> str | None:
    """The day that the path of an address names."""
    if m := re.search(r"/(\d{4})/(\d{1,2})/(\d{1,2})(?:/|$)", u or ""):
        try:
            return datetime.date(*map(int, m.groups())).isoformat()
        except ValueError:
            return None
    return None


# Media


def audio(root: Node) -> list[str]:
    """Addresses of the first audio element and of the sources inside it."""
    first = next(root.iter("audio"), None)
    if first is None:
        return []
    own = first.get("src")
    fits = own and (first.get("type") == "audio/mpeg" or own[-4:] in vocab.AUDIO_ENDS)
    return [*([own] if fits else []), *(s.get("src") for s in first.iter("source") if s.get("src"))]


def _watch(address: str) -> str:
    """The page of an embedded video."""
    if not address.startswith(vocab.YOUTUBE_EMBED):
        return address
    return vocab.YOUTUBE_WATCH + address[len(vocab.YOUTUBE_EMBED) :].split("?")[0]


def _with(root: Node, tag: str, **want: str) -> Node | None:
    """The first element with these attributes; a class may be one of several."""
    for n in root.iter(tag):
        if all(n.get(k.replace("_", "-")) == v or (k == "class_" and v in ((n.get("class") or ""), *(n.get("class") or "").split())) for k, v in want.items()):
            return n
    return None


def _playable(root: Node) -> str | None:
    """The address in the settings of a media player's figure."""
    player = _with(root, "div", class_="media-player-wrapper")
    figure = next(player.iter("figure"), None) if player else None
    try:
        return json.loads(figure.get("data-playable"))["settings"]["externalEmbedUrl"] if figure else None
    except (ValueError, KeyError, TypeError):
        return None


def video(root: Node, raw: str, graph: dict[str, str]) -> str | None:
    """The first rule whose element is there decides; then a frame of some size may state another address."""

    def decided() -> str | None:
        if (n := _with(root, "iframe", id="video")) and n.get("src"):
            return n.get("src") if n.get("src").startswith(vocab.YOUTUBE_EMBED) else None
        if n := _with(root, "div", data_test="VideoPlaceHolder", class_="PlaceHolder-wrapper"):
            return vocab.CNBC_EMBED + n.get("data-vilynx-id") if n.get("data-vilynx-id") else None
        if _with(root, "div", class_="vxp-media__summary"):
            return _playable(root)
        if n := _with(root, "div", class_="c-video-embed volume-video"):
            return vocab.VOX_EMBED + n.get("data-volume-uuid") if n.get("data-volume-uuid") else None
        if "xml" not in graph.get("video", "xml"):
            return graph["video"]
        if (at := raw.find(vocab.YOUTUBE_EMBED)) >= 0:
            return raw[at : at + 100].split('"')[0].replace("\\", "")
        if (n := _with(root, "div", id="art_video", class_="YTplayer")) and n.get("data-ytid"):
            return vocab.YOUTUBE_WATCH + n.get("data-ytid")
        if n := _with(root, "video", id="video_player"):
            return next((s.get("src") for s in n.iter("source")), None)
        n = _with(root, "video-player", video_type="youtube")
        return n.get("source") if n else None

    found = decided()
    frame = next((n for n in root.iter("iframe") if n.get("width") and n.get("height")), None)
    if frame and "0" not in (frame.get("width"), frame.get("height")):
        found = frame.get("content") or found
    if not found:
        return None
    found = _watch("https:" + found if found.startswith("//") else found)
    return None if any(b in found for b in vocab.BLOCKED_VIDEO) else found


FIELDS = ("title", "author", "url", "hostname", "description", "sitename", "license", "name", "video", "rawDate")
LISTS = ("categories", "tags", "audio")


def extract(raw: str | None, default_url: str | None = None, blocked: Iterable[str] = vocab.BLOCKED_AUTHORS, root: Node | None = None) -> dict:
    """All metadata of one page; missing values are None."""
    raw = raw or ""
    root = Indexed(root or parse(raw))
    said = meta_tags(root)
    first = said.first
    data = from_json(json_objects(root), first.get("sitename"))
    names = check_authors(first.get("author"), blocked)
    if names is None or re.match(r"https?://|/", names):
        names = author(root)
    address = url(root, said, default_url)
    section = said.dates.get("article:section")
    out = {
        "title": first.get("title") or data.get("title") or title(root),
        "author": names,
        "url": address,
        "hostname": domain(address),
        "description": first.get("description"),
        "sitename": site_name(data["sitename"], address),
        "license": licence(root),
        "name": data.get("name"),
        "video": video(root, raw, said.graph),
        "rawDate": raw_date(root, said) or data.get("rawDate") or shown_date(root) or address_date(address),
        "categories": data.get("categories") or linked(root, vocab.CATEGORY_MARKS, "/category/") or (split_tags(section) if section else []),
        "tags": said.tags or linked(root, vocab.TAG_MARKS, "/tags/"),
        "audio": audio(root),
    }
    done = {k: clean(out[k]) for k in FIELDS} | {k: [c for c in map(clean, out[k]) if c] for k in LISTS}
    return done | {"og_properties": said.graph}
