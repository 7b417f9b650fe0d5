"""Template removal: what articles share stays, boxes of adverts fall, and the counts are those of a plain twin."""

from __future__ import annotations

import collections
import random
import re

import pytest

from tessera.llm import html_extract as X

WORDS = "river garden letter window paper winter music stone bridge market captain forest".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n))


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


def frame(spark, pages):
    return spark.createDataFrame([(i, url, h, "clash", 1, "clash") for i, url, h in pages], "page_id long, url string, html string, host string, known int, blocks string")


def plain_extract(pages):
    """Texts by page: the rules of the operator over dictionaries."""
    parsed = []
    for i, url, source in pages:
        m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", url or "")
        parsed.append((i, m[1].lower() if m else "", source or "", X.blocks(source)))
    units = {}
    for _, host, source, (kept, own, slots, beside, article) in parsed:
        shape = [(len(t), {own[k] for k in marks}) for t, marks in kept]
        units[host, article if article is not None else source, article is not None] = (own, slots, shape)
        if article is not None:
            units[host, source, False] = (beside, [0] * len(beside), [])
    seen, slot_of, pages_of = collections.Counter(), {}, collections.Counter()
    for (host, _, within), (own, slots, _) in units.items():
        pages_of[host] += not within
        for h, s in zip(own, slots, strict=True):
            seen[host, h] += 1
            slot_of[host, h] = s
    again, held = collections.Counter(), collections.Counter()
    for (host, h), n in seen.items():
        if h & X.INSIDE:
            held[host, slot_of[host, h]] += n
            again[host, slot_of[host, h]] += n if n >= X.MIN_PAGES else 0
    sure, possible = set(), set()
    for (host, h), n in seen.items():
        slot = host, slot_of[host, h]
        if n < X.MIN_PAGES or (h & X.INSIDE and again[slot] < X.SLOT_SHARE * held[slot]):
            continue
        wide = n >= pages_of[host] * X.MIN_SHARE
        if wide and not h & X.INSIDE:
            sure.add((host, h))
        elif wide or h & X.LONG:
            possible.add((host, h))
    borne = collections.Counter()
    for (host, _, _), (own, _, shape) in units.items():
        cut = {h for h in own if (host, h) in possible}
        if sum(-n if marks & cut else n for n, marks in shape) >= 0:
            borne.update((host, h) for h in cut)
    template = sure | {k for k, n in borne.items() if n >= X.MIN_PAGES}
    return {i: "\n\n".join(t for t, marks in kept if not any((host, own[k]) in template for k in marks)) for i, host, _, (kept, own, *_) in parsed}


@pytest.mark.parametrize("few", [0, 200_000])
def test_what_articles_share_stays(spark, monkeypatch, few):
    monkeypatch.setattr(X, "BROADCAST_SUBTREES", few)
    rng = random.Random(8)
    shared = "The committee will meet again in the spring to hear all sides."
    advert = "<div class='k3'><p>Subscribers get two months of the paper for one.</p></div>"
    pages, want = [], {}
    for i in range(70):
        own = [prose(rng, 30) for _ in range(4)]
        has = i < 60
        body = f"<h1>{own[0]}</h1><p>{own[1]}</p>" + (f"<p>{shared}</p><h2>What happens next in the town</h2><ul><li>Read all of the decision of the court</li></ul><p><b>{shared}</b></p>" if has else "")
        # Wrapped paragraphs: one of them is shared, the slot holds fresh text on every page.
        body += f"<div class='para'><p>{own[2]}</p></div><div class='para'><p>{own[3]}</p></div>" + (f"<div class='para'><p>{shared}</p></div>" if has else "")
        pages.append((i, "https://paper.example/x", page(f"<article>{body}{advert if i % 8 == 0 else ''}</article>")))
        want[i] = "\n\n".join([own[0], own[1], *([shared, "What happens next in the town", "Read all of the decision of the court", shared] if has else []), own[2], own[3], *[shared] * has])
    got = {r.page_id: r.text for r in X.extract(frame(spark, pages)).collect()}
    assert got == want
    assert got == plain_extract(pages)


@pytest.mark.parametrize("few", [0, 200_000])
def test_counts_are_those_of_a_plain_twin(spark, monkeypatch, few):
    monkeypatch.setattr(X, "BROADCAST_SUBTREES", few)
    rng = random.Random(few + 1)
    boxes = [f"<div class='s{k}'><p>{prose(rng, rng.choice([1, 8]))}</p></div>" for k in range(6)]
    bits = [f"<p>{prose(rng, rng.choice([1, 12]))}</p>" for _ in range(8)]
    pages = []
    for i in range(160):
        inner = [rng.choice(boxes) if rng.random() < 0.3 else rng.choice(bits) if rng.random() < 0.3 else f"<div class='s{rng.randrange(6)}'>{prose(rng, 9)}</div>" if rng.random() < 0.2 else f"<p>{prose(rng, 15)}</p>" for _ in range(rng.randrange(1, 7))]
        body = "".join(inner)
        body = f"<div id='x'>{rng.choice(bits)}</div><article>{body}</article>" if rng.random() < 0.6 else f"<section>{body}</section>"
        pages.append((i, rng.choice(["https://a.example/1", "http://u@B.example:80/", "nonsense", None]), page(body)))
    pages += [(900 + i, "https://a.example/2", pages[0][2]) for i in range(9)] + [(950, None, None), (951, "https://a.example/", ""), (952, "https://a.example/", "<p>" + "word " * 200_000), (1, *pages[1][1:])]
    got = sorted((r.page_id, r.text) for r in X.extract(frame(spark, pages)).collect())
    plain = plain_extract(pages)
    assert got == sorted((i, plain[i]) for i, *_ in pages)
    whole = {i: "\n\n".join(t for t, _ in X.blocks(h)[0]) for i, _, h in pages}
    assert any(plain[i] != whole[i] for i in whole)
