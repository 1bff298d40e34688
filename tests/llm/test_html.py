import re
import time
from itertools import product

import numpy as np
import pytest

from lodestone.llm import html_extract as X
from lodestone.llm import queries


def page(k, marked=True):
    rng = np.random.default_rng(k)
    prose = lambda n: " ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(n)) + "."
    body = "".join(f"<p>{prose(int(rng.integers(12, 60)))}</p>" for _ in range(int(rng.integers(2, 7))))
    tag, nav, foot = ("article", "nav", "footer") if marked else ("div", "div", "div")
    links = "".join(f'<li><a href="/{k}">{prose(2)}</a></li>' for _ in range(6))
    return f'<html><head><title>{prose(4)}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><{nav} class="menu"><ul>{links}</ul></{nav}><div class="ad">{prose(6)}</div><{tag}><h1>{prose(5)}</h1>{body}</{tag}><{foot} class="footer">&copy; {prose(7)}</{foot}></body></html>'


@pytest.fixture(scope="module")
def forest():
    pages = [X.parse(page(k)) for k in range(60)]
    b = X.Batch(pages)
    some = np.flatnonzero(b.own > 0)
    return X._gbt.fit(b.features()[some], (b.mark[some] > 0).astype(int), 40, 4)


def test_held_out_accuracy(forest):
    b = X.Batch([X.parse(page(k)) for k in range(1000, 1040)])
    some = np.flatnonzero(b.own > 0)
    assert ((forest.raw(b.features()[some]) > 0) == (b.mark[some] > 0)).mean() > 0.97


def test_pages_without_marks(forest):
    for k in range(2000, 2010):
        marked, plain = (X.extract([page(k, m)], forest)[0][0] for m in (True, False))
        assert marked == plain and marked.count("\n") >= 2 and "©" not in marked


def test_decoding_against_all_closed_sets():
    rng = np.random.default_rng(15)
    for _ in range(60):
        n = int(rng.integers(1, 10))
        parent = np.array([-1, *(int(rng.integers(0, k)) for k in range(1, n))])
        depth = np.zeros(n, int)
        for k in range(1, n):
            depth[k] = depth[parent[k]] + 1
        gain = rng.normal(size=n).round(3)
        keep = X.keep_closed(parent, depth, gain)
        closed = [s for s in product([False, True], repeat=n) if all(s[parent[k]] or not s[k] for k in range(1, n))]
        assert tuple(keep) in closed
        assert np.isclose(gain[keep].sum(), max(gain[list(s)].sum() for s in closed))


@pytest.mark.parametrize("source, texts", [("", []), ("a<b", ["a", "<", "b"]), ("<p>one<p>two", ["one", "two"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("x<!-- <p>no</p> -->y", ["x", "y"]), ("<script>if (a<b) '</p>'</script>z", ["z"]), ("</div>a</p>", ["a"]), ("<b>a<i>b</b>c</i>", ["a", "b", "c"]), ("<img src='a>b'>t&amp;c", ["t&c"]), ("<p title=\"a", ["<", "p title=\"a"])])
def test_parsing_is_lenient(source, texts):
    p = X.parse(source)
    assert p.text == texts
    assert all(-1 < q < k for k, q in enumerate(p.parent) if k) and all(k < e <= len(p.parent) for k, e in enumerate(p.end))


def test_subtrees_of_a_batch():
    b = X.Batch([X.parse("<div><p>ab</p><p>c</p></div>d"), X.parse(""), X.parse("<p>xyz</p>")])
    assert b.subtree(b.own).tolist() == [4, 3, 2, 1, 0, 3, 3]
    assert b.features().shape == (7, len(X.FEATURES)) and np.isfinite(b.features()).all()


def test_tables(spark):
    rows = [(k, f"http://x/{k}", page(k)) for k in range(80)] + [(None, "u", page(1)), (200, "u", None), (201, "u", ""), (202, None, "<p>" + "long text. " * 30_000), (5, "again", page(5))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for clash in ("text", "id", "x", "h", "g"):
        frame = frame.withColumn(clash, frame.url)
    forest = X.fit_extractor(frame, max_pages=40)
    got = X.extract_text(frame, forest).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got if r.page_id is not None}
    assert by[200].text is None and by[201].text == "" and by[201].n_nodes == 1
    assert by[5].text and "©" not in by[5].text
    none = frame.where("page_id < 0")
    assert X.extract_text(none, X.fit_extractor(none)).count() == 0
    unmarked = spark.createDataFrame([(1, "<div>all of it</div>")], "page_id long, html string")
    assert X.extract_text(unmarked, X.fit_extractor(unmarked)).first().text == "all of it"


@pytest.mark.parametrize("source, texts", [('<p>a</p><svg class="icon"/><p>b</p>', "ab"), ('<svg class="icon"/><p>a</p><svg><text>x</text></svg><p>b</p>', "ab"), ("<p>a</p><noscript><p>b</p>", "ab"), ("<template><p>a</p>", "a"), ("<svg><p>a</p><svg>x</svg><p>b</p>", "ab"), ("<svg><svg>x</svg>y</svg><p>a</p>", "a"), ("<noscript>x</noscript><template>y</template><p>a</p>", "a")])
def test_what_is_skipped_has_an_end(source, texts):
    assert "".join(X.parse(source).text) == texts


def naive(source):
    """The same rules by plain scans: (parents, kinds, texts), with a stack that is searched from the top each time."""
    parents, kinds, texts, stack, at = [-1], ["#root"], [], [(0, "#root")], 0

    def tag_end(i):
        while i < len(source):
            if source[i] == ">":
                return i
            if source[i] in "\"'":
                i = source.find(source[i], i + 1)
                if i < 0:
                    return -1
            i += 1
        return -1

    def skip(tag, begin):
        level, i = 1, begin
        while (i := source.lower().find("<", i)) >= 0:
            close = source[i + 1 : i + 2] == "/"
            name = i + 1 + close
            if source[name : name + len(tag)].lower() == tag and source[name + len(tag) : name + len(tag) + 1] in tuple(" \t\n/>") and source[name + len(tag) : name + len(tag) + 1]:
                e = tag_end(name + len(tag))
                if e >= 0:
                    level += -1 if close else 0 if tag == "svg" and source[e - 1] == "/" else 1
                    if level == 0:
                        return e + 1
            i += 1
        return begin

    while at < len(source):
        if source.startswith("<!--", at):
            e = source.find("-->", at + 4)
            at = len(source) if e < 0 else e + 3
            continue
        if source[at] != "<":
            e = at
            while e < len(source) and source[e] != "<":
                e += 1
            if source[at:e].strip():
                texts.append((stack[-1][0], source[at:e]))
            at = e
            continue
        close = source[at + 1 : at + 2] == "/"
        name = at + 1 + close
        letter = source[name : name + 1].isascii() and source[name : name + 1].isalpha()
        e = tag_end(name) if letter else source.find(">", at) if source[at + 1 : at + 2] in ("/", "!", "?") else -1
        if e < 0:
            texts.append((stack[-1][0], "<"))
            at += 1
            continue
        at = e + 1
        if not letter:
            continue
        k = name
        while k < e and not source[k].isspace() and source[k] not in "/>":
            k += 1
        tag, rest = source[name:k].lower(), source[k:e]
        tags = [t for _, t in stack]
        inner = lambda k: any(t in X._P_SCOPE for t in tags[k + 1 :])
        if close:
            if tag in tags[1:]:
                k = len(tags) - 1 - tags[::-1].index(tag)
                if tag in X._BLOCK or not inner(k):
                    del stack[k:]
            continue
        if tag in X._P_ENDS and "p" in tags:
            k = len(tags) - 1 - tags[::-1].index("p")
            if not inner(k):
                del stack[k:]
        elif tag in X._ENDS:
            for k in range(len(tags) - 1, 0, -1):
                if tags[k] in X._ENDS[tag][0]:
                    del stack[k:]
                    break
                if tags[k] in X._ENDS[tag][1]:
                    break
        node = len(parents)
        parents.append(stack[-1][0])
        kinds.append(tag)
        if tag in ("script", "style", "textarea"):
            e = source.lower().find(f"</{tag}>", at)
            at = len(source) if e < 0 else e + len(tag) + 3
        elif tag in ("noscript", "template", "svg"):
            if not (tag == "svg" and rest.endswith("/")):
                at = skip(tag, at)
        elif tag not in X._VOID:
            stack.append((node, tag))
    return parents, [X._KIND.get(t, X._OTHER) for t in kinds[1:]], texts


def test_against_a_parser_of_plain_scans():
    rng = np.random.default_rng(31)
    pieces = ["<p>", "</p>", "<div class='a>b'>", "</div>", "<ul>", "</ul>", "<li>", "<b>", "</b>", "<svg/>", "<svg a=1>", "</svg>", "<noscript>", "</noscript>", "<template>", "</template>", "<table>", "<tr>", "<td>", "</td>", "</table>", "<br/>", "<img src=x>", "<script>", "</script>", "<!-- c -->", "<!--", "-->", "text ", "< ", "<", ">", '"', "'", "<a href=\"q\">", "</a>", "</", "<!x>", "<?y>", "<dl>", "<dt>", "<dd>", "</dl>", "<span", " title='", "<h1>", "</h1>", "x<y ", "<textarea>", "</textarea>"]
    for _ in range(3000):
        source = "".join(rng.choice(pieces, int(rng.integers(1, 40))))
        page = X.parse(source)
        parents, kinds, texts = naive(source)
        assert page.parent == parents and page.kind[1:] == kinds, source
        assert list(zip(page.text_node, page.text, strict=True)) == texts, source


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<svg ", "<p><svg>", '<a "', "</a ", "<!", "<b><p>", "<noscript>", "<li>", "<script", "<dt><dd>", "&", "<table><tr>"])
def test_long_hostile_pages_are_linear(piece):
    forest = X._gbt.fit(np.zeros((0, len(X.FEATURES))), np.zeros(0))
    began = time.perf_counter()
    X.extract([piece * 100_000 + "end"], forest)
    assert time.perf_counter() - began < 20


def test_the_query_on_whole_pages(spark, tmp_path):
    """op2 from table to text: content stays, what stands around goes, inline icons and broken tags cost nothing else."""
    odd = lambda k, s: s.replace("<h1>", '<svg class="icon"/><noscript><h1>', 1) if k % 3 == 0 else s.replace("</h1>", "</h1><svg><text>icon</text></svg>", 1) if k % 3 == 1 else s
    rows = [(k, "u", odd(k, page(k, k % 5 > 0))) for k in range(150)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in queries.op2_html_extraction(spark, str(tmp_path)).collect()}
    assert len(got) == 150
    for k, _, source in rows:
        body = re.findall(r"<p>([^<]+)</p>", source)
        assert [x for x in body if x not in got[k]] == [] and "©" not in got[k] and "icon" not in got[k].split()
        ads = re.search(r'<div class="ad">([^<]+)<', source)[1]
        assert ads not in got[k]
