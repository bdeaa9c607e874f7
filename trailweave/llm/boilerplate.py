"""Fits the weights of the classifier of mainhtml: python -m trailweave.llm.boilerplate pages.parquet

Labels come from pages that mark their article by an element. Each page's article and its surroundings are laid out
anew at random, in layouts of many sites: with elements, with classes, with both or with neither, with comments and
adverts inside the article, and with sections in it whose names sound like boilerplate. So no sign is always there,
and the weights of the text's own features are learned beside those of its place. At most `pages` pages are used."""

from __future__ import annotations

import html
import random
import re
import sys

import numpy as np

from . import mainhtml

_NEGATIVE = [
    ("nav", "main-menu"), ("footer", "site-footer"), ("aside", "sidebar"), ("header", "masthead"), ("div", "ad"), ("div", "cookie-notice"), ("section", "comments"), ("div", "related-posts"),
    ("div", "newsletter-box"), ("div", "social-share"), ("ul", "breadcrumbs"), ("div", "widget"), ("div", "promo-banner"),
]
_POSITIVE = [("article", "post"), ("main", "content"), ("div", "entry-content"), ("div", "article-body"), ("div", "")]
_SOUNDS = ["related-work", "side-effects", "form-of-government", "notice-periods", "menu-engineering", "ads-in-history"]


def _wrapped(r: random.Random, tag: str, name: str, inner: str) -> str:
    tag = tag if r.random() < 0.5 else "div"
    return f"<{tag} class=\"{name}\">{inner}</{tag}>" if name and r.random() < 0.5 else f"<{tag}>{inner}</{tag}>"


def laid_out(r: random.Random, title: str, article: list[str], others: list[str]) -> tuple[str, set[str]]:
    """A page, and the texts that are content in it. others: sentences of other pages."""
    say = lambda n: " ".join(r.choice(others) for _ in range(n))

    def aside() -> str:
        tag, name = r.choice(_NEGATIVE)
        links = "".join(f"<li><a href=x>{html.escape(' '.join(say(1).split()[: r.randrange(1, 9)]))}</a></li>" for _ in range(r.randrange(2, 9)))
        inner = r.choice([f"<ul>{links}</ul>", f"<p>{html.escape(say(r.randrange(1, 4)))}</p>", f"<h2>{html.escape(say(1)[:20])}</h2><ul>{links}</ul>", "".join(f"<p>{html.escape(say(1))}</p>" for _ in range(3))])
        return _wrapped(r, tag, name, inner) if "<li>" in inner and r.random() < 0.3 else f"<{tag} class=\"{name}\">{inner}</{tag}>"

    heads = [" ".join(say(1).split()[: r.randrange(1, 5)]) if r.random() < 0.4 else "" for _ in article]
    body = [f"<h1>{html.escape(title)}</h1>"]
    for head, p in zip(heads, article, strict=True):
        body += [f"<h2>{html.escape(head)}</h2>"] * bool(head) + [f"<p>{html.escape(p)}</p>"]
    if r.random() < 0.3 and len(body) > 3:
        k = r.randrange(1, len(body) - 1)
        body[k : k + 2] = [f"<section class=\"{r.choice(_SOUNDS)}\">{''.join(body[k : k + 2])}</section>"]
    if r.random() < 0.4:
        body.insert(r.randrange(1, len(body) + 1), aside())
    tag, name = r.choice(_POSITIVE)
    page = [aside() for _ in range(r.randrange(3))] + [_wrapped(r, tag, name, "".join(body))] + [aside() for _ in range(r.randrange(3))]
    for k, part in enumerate(page):
        n = r.randrange(5)
        page[k] = "<div>" * n + part + "</div>" * n
    if r.random() < 0.3:
        page.append("<p>&copy; 2020 " + html.escape(say(1)[:30]) + "</p>")
    return f"<body>{''.join(page)}</body>", {" ".join(t.split()) for t in [title, *heads, *article]}


def examples(pages: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of pages that mark their article."""
    r, parts = random.Random(seed), []
    for page in pages:
        if inner := re.search(r"<article>(.*?)</article>", page, re.S):
            texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", t)).split()) for t in re.split(r"</?(?:h1|p)>", inner[1])]
            parts.append([t for t in texts if t])
    others = [s for p in parts for t in p for s in re.findall(r"[^.]+\.", t)]
    x, y = [], []
    for p in parts:
        page, content = laid_out(r, p[0], p[1 : r.randrange(2, len(p) + 2)], others)
        for block in mainhtml.blocks(page):
            x.append(block.features())
            y.append(block.text in content)
    return np.array(x), np.array(y, float)


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps. The bias isn't held back."""
    w, held = np.zeros(x.shape[1]), ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + held, x.T @ (p - y) + held @ w)
    return w


def main(path: str, pages: int = 5000) -> None:
    import pyarrow.parquet as pq

    x, y = examples([h for h in pq.read_table(path, columns=["html"]).column(0).to_pylist()[:pages] if h])
    w = fitted(x, y)
    print(len(y), "blocks,", round(float(((x @ w > 0) == (y > 0)).mean()), 4), "right before the cut")
    print([round(float(v), 2) for v in w])


if __name__ == "__main__":
    main(sys.argv[1])
