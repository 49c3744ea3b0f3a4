"""HTML extraction: pages of every odd sort, and the template against exact occurrence vectors in plain Python."""

import random
import time
from collections import Counter, defaultdict

import pytest

from lodestone.llm import templates

SCHEMA = "html string, page_id long, host string, url string, text int, tokens string"


def article(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav>{body}<footer>&copy; x</footer></body></html>"


CASES = {
    "article": (article("<article><h1>A&amp;B</h1><p>one\n two<br>three<p><b>four</article>"), "A&B\n\none two three\n\nfour"),
    "parts": (article("<article><header><h1>H</h1></header><p>a</p><aside>no</aside><form>no</form><div class='ad x'>no</div><p>b</p><footer>no</footer><section id=comments><article><p>no</article></section></article>"), "H\n\na\n\nb"),
    "inline": (article("<article><p>a <span class=ad>no</span>b<script>if (a</p>b) '</p>'</script> c <button>no</button>d</p></article>"), "a b c d"),
    "unclosed inline": (article("<article><p>a <span hidden>no</p><p>b</p></article>"), "a\n\nb"),
    "quotes": (article("<article><p title=\"a>b\" class='x>'>one</p><p class=\"it's>two</p></article>"), "one\n\ntwo"),
    "links": (article("<div><p>See <a href=/>this</a> now</p><p><a href=/>only</a></p></div>"), "See this now"),
    "main": (article("<div>no</div><main><p>yes</p><div class=newsletter>no</div></main>"), "yes"),
    "role": (article("<div>no</div><div role=main><p>yes</p></div>"), "yes"),
    "mark around": (article("<div class=has-sidebar><article><p>yes</p></article><div class=sidebar>no</div></div>"), "yes"),
    "empty article": (article("<article> </article><p>yes</p>"), "yes"),
    "signs": (article("<article><p>1 < 2 &lt; 3 &#x41;&nbsp;b &unknown; &copy</p></article>"), "1 < 2 < 3 A b &unknown; ©"),
    "comment": (article("<article><p>a<!-- <p>no --></p><!--><p>b</p></article><!-- open"), "a\n\nb"),
    "cut": ("<html><body><article><p>a</p><p>b <a hre", "a\n\nb"),
    "cut script": ("<article><p>a</p><script>no <p>no</p>", "a"),
    "plain": ("just text", "just text"),
    "list": (article("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>"), "a\n\nb\n\nc\n\nd\n\ne"),
    "none": ("", ""),
}


@pytest.mark.parametrize("name", list(CASES))
def test_page(name):
    html, text = CASES[name]
    assert templates.Page(html).text(set()) == text


@pytest.mark.parametrize("piece", ["<", "<a ", '<a "', "<p>", "<div>", "</p>", "<b><p>", "<!--", "<li>x", "&#", "<script>", "<span class=ad>", "<td", "</"])
def test_long_pages_take_linear_time(piece):
    start = time.time()
    templates.Page(piece * (1_000_000 // len(piece))).text(set())
    assert time.time() - start < 20


def pages(n, seed):
    """A site whose boilerplate has no telling names: only the template tells it from the text."""
    r = random.Random(seed)
    words = lambda: " ".join(r.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=12))
    for k in range(n):
        own = [f"{words()} {k} {j}" for j in range(r.randint(1, 5))]
        body = "".join(f"<div class=row><p>{t}</p></div>" for t in own)
        yield f"<html><body><div class=top><p>Welcome to the site</p></div>{body}<div><p>All texts by the makers</p></div></body></html>", "\n\n".join(own)


def run(spark, rows):
    return templates.extract(spark.createDataFrame(rows, SCHEMA)).collect()


def test_template_texts_go(spark):
    made = list(pages(12, 1))
    rows = [(html, k, "clash", "https://a.example/" + str(k), 1, "clash") for k, (html, _) in enumerate(made)]
    lone = [(made[0][0], 90, "", "https://b.example/", 1, ""), (None, 91, "", None, 1, ""), ("", 92, "", "", 1, ""), (made[1][0], 93, "", "no url", 1, ""), rows[3]]
    lone.append(("<article>" + "<p>word</p>" * 100_000 + "</article>", None, "", "https://c.example", 1, ""))
    found = Counter((r.page_id, r.url, r.text, r.n_chars) for r in run(spark, rows + lone))
    want = [(k, f"https://a.example/{k}", text, len(text)) for k, (_, text) in enumerate(made)]
    whole = [f"Welcome to the site\n\n{made[k][1]}\n\nAll texts by the makers" for k in (0, 1)]
    want += [want[3], (90, "https://b.example/", whole[0], len(whole[0])), (91, None, "", 0), (92, "", "", 0), (93, "no url", whole[1], len(whole[1]))]
    many = "\n\n".join(["word"] * 100_000)
    assert found == Counter(want + [(None, "https://c.example", many, len(many))])
    assert run(spark, []) == []


def test_copies_of_an_article_are_kept(spark):
    html = article("<article><h1>Same</h1><p>The same article on every page.</p></article>")
    assert {r.text for r in run(spark, [(html, k, "", "http://a.example/", 0, "") for k in range(30)])} == {"Same\n\nThe same article on every page."}


@pytest.mark.parametrize("most", [0, 200_000])
def test_template_equals_exact_vectors(spark, monkeypatch, most):
    monkeypatch.setattr(templates, "MOST_BROADCAST", most)
    made = [html for html, _ in pages(40, 2)] + [html for html, _ in pages(15, 3)]
    rows = [(f"h{k % 3 if k < 40 else 4}", f"key{k}", html) for k, html in enumerate(made)]
    df = spark.createDataFrame([(h, k, html) for k, (h, _, html) in enumerate(rows)], "host string, key long, html string")
    got = {r.host: set(r.tokens) for r in templates.deduce(df, templates.Scratch(spark, "test"))[0].collect()}
    by = defaultdict(list)
    for host, _, html in rows:
        by[host].append(templates.Page(html).tokens)
    want = {}
    for host, lists in by.items():
        counts = [Counter(tokens) for tokens in lists]
        vectors = {t: tuple(c[t] for c in counts) for t in set().union(*lists)}
        class_of = {t: v for t, v in vectors.items() if sum(map(bool, v)) >= max(3, len(lists) / 2)}
        number = {v: i for i, v in enumerate(sorted(set(class_of.values())))}
        seen = defaultdict(set)
        for tokens in lists:
            for c, *rest in templates.roles(tokens, {t: number[v] for t, v in class_of.items()}):
                seen[c].add(tuple(rest))
        # slots are named by the hash of the class around, so only their number is compared
        valid = {c for c, found in seen.items() if len(found) == 1 and all(good for good, *_ in found)}
        want[host] = {t for t, v in class_of.items() if number[v] in valid}
    assert got == want


def test_valid_classes():
    good = lambda tokens, classes: {c: ok for c, ok, *_ in templates.roles(tokens, classes)}
    assert good([1, 3, 4, 3, 4, 2], {1: 0, 2: 0, 3: 1, 4: 1}) == {0: True, 1: True}
    assert good([1, 3, 2, 4], {1: 0, 2: 0, 3: 1, 4: 1}) == {0: True, 1: False}  # crosses
    assert good([1, 2, 2, 1], {1: 0, 2: 0}) == {0: False}  # no one order
    assert good([1, 3, 2, 3], {1: 0, 2: 0, 3: 1}) == {0: True, 1: False}  # inside and behind
