"""Blocks of a tree with what only a tree tells: ancestors, class weights, depth, exact tag counts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pagelathe.functions.tree import Node
from pagelathe.functions.vocab import BAD_WORDS, BLOCK_TAGS, CLASS_WEIGHT, GOOD_WORDS, IGNORED, IGNORED_VOID, TAG_WEIGHTS

_BLOCK, _SKIP = frozenset(BLOCK_TAGS), frozenset((*IGNORED, *IGNORED_VOID))
_GOOD, _BAD = (re.compile("|".join(map(re.escape, words)), re.I) for words in (GOOD_WORDS, BAD_WORDS))
_PIECES = re.compile("[^A-Za-z0-9]+")
_TOKENS = re.compile(r"[^ \t\n\r\f\v]+")


def weight(node: Node) -> int:
    """Score of a node by its id, class and tag."""
    out = TAG_WEIGHTS.get(node.tag, 0)
    for name in ("id", "class"):
        value = node.get(name)
        if value:
            out += CLASS_WEIGHT * (bool(_GOOD.search(value)) - bool(_BAD.search(value)))
    return out


class Walk:
    """One depth-first pass; `blocks` holds a dict per block.

    `features`: by name, a number from the nodes that were met since the block before.
    """

    def __init__(self, root: Node, features: dict[str, Callable[[list[Node]], float]] | None = None) -> None:
        self.features, self.nodes = features or {}, [root]
        self.blocks: list[dict] = []
        self.ids, self.path = 0, [0]
        self.tokens: list[str] = []
        self.links: list[str] = []
        self.tag, self.css = "", {"id": [], "class": []}
        self.ancestors: list[int] = []
        self.weights: list[tuple[int, int]] = [(0, weight(root))]
        self.count, self.since, self.anchors = 1, 0, 0
        self.depth = self.pending = self.last = 0
        self._read(root.text)
        self._enter(root)
        self._flush()

    def _read(self, text: str) -> None:
        self.tokens += _TOKENS.findall(text)

    def _flush(self) -> None:
        if self.tokens:
            self.blocks.append({
                "pos": len(self.blocks), "start_tag": self.tag, "css_id": " ".join(self.css["id"]), "css_class": " ".join(self.css["class"]), "text": " ".join(self.tokens),
                "extra": {name: float(make(self.nodes)) for name, make in self.features.items()}, "tagcount": self.count - 1, "since_last": self.since, "anchors": self.anchors, "min_depth": self.last, "ancestors": self.ancestors, "weights": self.weights,
            })
            self.weights, self.nodes, self.since = [], [], 0
            self.pending = self.last = self.depth
        else:
            self.since += self.count - 1
        self.count, self.anchors = 1, 0

    def _style(self, node: Node) -> None:
        for name in ("id", "class"):
            if node.get(name):
                self.css[name].append(node.get(name).lower())

    def _enter(self, root: Node) -> None:
        stack: list[tuple] = [("in", root)]
        while stack:
            step, node, *more = stack.pop()
            if step == "in":
                self.depth += 1
                self.pending = min(self.pending, self.depth)
                burnt = bool(node.children)
                self.ids += burnt
                stack.append(("out", node))
                stack.extend(("child", c) for c in reversed(node.children))
            elif step == "out":
                self.depth -= 1
                self.pending = min(self.pending, self.depth)
            elif step == "tail":
                self.path.pop()
                self._read(node.tail)
            else:
                self.ids += 1
                self.count += 1
                self.anchors += node.tag == "a"
                if node.tag in _SKIP:
                    self.last = self.pending
                    self._read(node.tail)
                    continue
                here = self.ids
                if node.tag in _BLOCK:
                    self._flush()
                    self.tokens, self.tag, self.css = [], node.tag, {"id": [], "class": []}
                    self.ancestors = list(self.path)
                else:
                    self.last = self.pending
                self.weights.append((here, weight(node)))
                self.nodes.append(node)
                self._style(node)
                self.path.append(here)
                self._read(node.text)
                stack.append(("tail", node))
                stack.append(("in", node))


def readability(blocks: list[dict]) -> list[float]:
    """Score of each block by its best valid ancestor, as a share of the page's best.

    An ancestor is valid if it is the nearest of a `div` or `p` of more than 25 bytes; each of those adds
    to its class weight, and the share of link text below it takes off. `features.readability` does the same
    on rows.
    """
    weight_of = dict(w for b in blocks for w in b["weights"])
    gained, linked, bytes_below = Counter(), Counter(), Counter()
    for b in blocks:
        size = len(b["text"].encode())
        density = 1 / len(_PIECES.split(b["text"]))
        linked.update(dict.fromkeys(b["ancestors"], density * size))
        bytes_below.update(dict.fromkeys(b["ancestors"], size))
        if size > 25 and b["start_tag"] in ("div", "p") and b["ancestors"]:
            gained[b["ancestors"][-1]] += 1 + min(size // 100, 3)
    score = {n: (weight_of.get(n, 0) + g) * (1 - linked[n] / max(bytes_below[n], 1)) for n, g in gained.items()}
    top = max([1.0, *score.values()])
    return [max([0.0, *(score[n] / top for n in b["ancestors"] if n in score)]) for b in blocks]


def blocks(root: Node, features: dict[str, Callable[[list[Node]], float]] | None = None) -> list[dict]:
    """The blocks of a tree, each with its readability and `extra`, the numbers of `features`."""
    made = Walk(root, features).blocks
    return [b | {"readability": r} for b, r in zip(made, readability(made), strict=True)]
