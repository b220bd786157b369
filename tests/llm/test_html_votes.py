"""Pages whose layout names, forms or language must not cost them their article; both passes against a plain restatement."""

import random
import re

import pytest

from lodestone.llm import htmltext

TEXT = {
    "en": "The museum of the city opened its doors again yesterday after three years of work. The visitors found new rooms, better light and a guide for children. The director said that it will be open until the end of the next month.",
    "it": "Il museo della città ha riaperto le porte ieri mattina dopo tre anni di lavori. I visitatori hanno trovato sale nuove, luci migliori e una guida per bambini. Secondo il direttore, la mostra resterà aperta fino alla fine del prossimo mese.",
    "pl": "Muzeum miejskie otworzyło wczoraj drzwi po trzech latach remontu. Zwiedzający znaleźli nowe sale, lepsze światło i przewodnik dla dzieci. Zdaniem dyrektora wystawa potrwa do końca przyszłego miesiąca i będzie bezpłatna dla uczniów.",
    "pt": "O museu da cidade reabriu ontem as portas depois de três anos de obras. Os visitantes encontraram salas novas, luzes melhores e um guia para crianças. Segundo o diretor, a exposição ficará aberta até o fim do próximo mês.",
    "sv": "Stadens museum öppnade i går sina dörrar efter tre års arbete. Besökarna fann nya salar, bättre ljus och en guide för barn. Enligt chefen är utställningen öppen till slutet av nästa månad och gratis för skolelever.",
    "el": "Το μουσείο της πόλης άνοιξε ξανά χθες το πρωί μετά από τρία χρόνια εργασιών. Οι επισκέπτες βρήκαν νέες αίθουσες, καλύτερο φως και έναν οδηγό για παιδιά. Σύμφωνα με τον διευθυντή, η έκθεση θα μείνει ανοιχτή ως το τέλος του μήνα.",
}
LAYOUTS = {
    "class on a wrapper": "<div class='content sidebar-right'>{}</div>",
    "open menu on a wrapper": "<div class='wrapper nav-open'>{}</div>",
    "a topic": "<section class='social-science'>{}</section>",
    "a tour": "<article class='promo-tour'>{}</article>",
    "free of adverts": "<article class='ad-free'>{}</article>",
    "links inside an article": "<article><div class='entry social-links-on'>{}</div></article>",
    "a form round the page": "<form id=aspnetForm><input type=hidden>{}</form>",
    "nested wrappers": "<div class='page menu-left'><div class='skip related-wide'>{}</div></div>",
    "role of search": "<div role=search>{}</div>",
    "plain": "<div>{}</div>",
}
AROUND = ("<nav><a href=/>Home</a></nav><ul><li><a href=/n>News</a></li></ul><div class=sidebar><p>Short words beside it.</p></div>", "<section class=comments><p>I was there and it was nice.</p></section><footer>Somebody, 2024</footer>")


@pytest.mark.parametrize("lang", sorted(TEXT))
@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_articles_survive_their_layout(layout, lang):
    page = LAYOUTS[layout].format(f"<p>{TEXT[lang]}</p><p>{TEXT[lang]}</p>")
    assert htmltext.main_text(f"<body>{page}</body>") == f"{TEXT[lang]} {TEXT[lang]}"
    assert htmltext.main_text(f"<body>{AROUND[0]}{page}{AROUND[1]}</body>") == f"{TEXT[lang]} {TEXT[lang]}"


@pytest.mark.parametrize("lang", sorted(TEXT))
def test_boilerplate_stays_out(lang):
    x = TEXT[lang]
    article = f"<article><p>{x}</p></article>"
    for other in (f"<section class=comments>{f'<p>{x}</p>' * 5}</section>", f"<div class=related><p>{x[:100]}</p></div>", f"<form><p>{x[:120]}</p><input></form>", f"<aside><p>{x}</p><p>{x}</p></aside>", f"<article class=comment-body><p>{x} {x}</p></article>"):
        assert htmltext.main_text(f"<body>{article}{other}</body>") == x
        assert htmltext.main_text(f"<body>{other}{article}</body>") == x
    assert htmltext.main_text(f"<footer><p>{x}</p></footer><nav><p>{x}</p></nav>") == ""


def plain(found):
    """Both passes as the docstring tells them, with every block looking at every other."""
    marked = [b for b in found if not b.bad and b.article and len(b.text) > b.linked]
    pool, share = (marked, 0.5) if marked else ([b for b in found if not b.bad], 2 / 3)
    free = lambda bs: sum(len(b.text) - b.linked for b in bs)
    kept = {v for b in pool for v in b.votes if free(pool) and free([x for x in pool if v in x.votes]) >= share * free(pool)}
    words = lambda text: re.findall(r"[^\W\d_]+", text.lower())
    stops = lambda ws: sum(w in htmltext.STOP_WORDS for w in ws) / len(ws) if ws else 0
    all_words = [w for b in found if not b.bad and len(b.text) >= 70 and 2 * b.linked <= len(b.text) for w in words(b.text)]
    strange = len(all_words) >= 20 and stops(all_words) < 0.25

    def first(b):
        if b.bad or any(v not in kept for v in b.votes) or b.linked / len(b.text) > (0.5 if b.article else 0.2):
            return -1
        ws = words(b.text)
        if 2 * sum(c.isalpha() and ord(c) > 0x24F for c in b.text) > sum(map(len, ws)):
            return 0 if len(b.text) + 2 * len(htmltext.DENSE.findall(b.text)) < 200 else 1
        if len(b.text) < 70:
            return 0 if b.article or not b.linked else -1
        enough = htmltext._in_sentences(b.text) if strange else stops(ws) >= 0.3
        plenty = htmltext._in_sentences(b.text) if strange else stops(ws) >= 0.32
        return 1 if plenty and len(b.text) >= 200 or b.article and enough else 0 if enough or b.article else -1

    labels = [first(b) for b in found]

    def second(i):
        if labels[i]:
            return labels[i]

        def side(step):
            j, d = i + step, 1
            while 0 <= j < len(found) and found[j].article == found[i].article:
                if labels[j]:
                    return d, labels[j]
                j, d = j + step, d + 1
            return d, 0 if found[i].article else -1

        (dl, a), (dr, b) = side(-1), side(1)
        if found[i].article:
            return -1 if a == b == -1 else 1
        if found[i].heading:
            return b
        return a if a == b or dl < dr else b if dr < dl else -1

    out = [second(i) for i in range(len(found))]
    if 1 not in out:
        out = [1 if not b.bad and len(b.text) >= 200 and b.linked <= 0.2 * len(b.text) and htmltext._in_sentences(b.text) else -1 for b in found]
    return out


def random_page(rnd):
    def inner(depth):
        out = ""
        for _ in range(rnd.randint(1, 4)):
            text = TEXT[rnd.choice(sorted(TEXT))][: rnd.choice([20, 60, 150, 400])]
            kind = rnd.random()
            if kind < 0.35 and depth < 4:
                tag = rnd.choice(["div", "section", "article", "form", "aside", "header", "main", "ul"])
                out += f"<{tag} class='{rnd.choice(['', 'sidebar', 'social-x', 'comments', 'content', 'promo', 'no-menu'])}'>{inner(depth + 1)}</{tag}>"
            elif kind < 0.5:
                out += f"<h2>{text[:30]}</h2>"
            elif kind < 0.65:
                out += f"<p><a href=x>{text[:40]}</a> {text[40:60]}</p>"
            else:
                out += f"<p>{text}</p>"
        return out

    return f"<body>{inner(0)}</body>"


def test_both_passes_against_a_plain_restatement():
    rnd = random.Random(7)
    seen = set()
    for _ in range(400):
        found = htmltext.blocks(random_page(rnd))
        got = htmltext.classify(found)
        assert got == plain(found)
        seen.update(got)
    assert seen == {1, -1}


def test_given_pages_have_text():
    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist():
        assert not page or htmltext.main_text(page)
