"""Text rules on hand-written rows."""

import html
import re

import pytest
from pyspark.sql import functions as F

from seqloom.functions import arrays, prompts, sids, text

# text, what review cleaning gives, what encoder cleaning gives
CASES = [
    ("", "", "."),
    ("  ", "", "."),
    ("plain", "plain", "plain."),
    ("a<b>c</b> <i>d", "ac d", "ac d."),
    ("x &amp;quot; y &amp;amp; z", 'x " y & z', "x &quot; y &amp; z."),
    ("&lt;b&gt;bold&lt;/b&gt; tail...", "<b>bold</b> tail...", "bold tail."),
    ("...", "...", ".."),
    (".", ".", ".."),
    ("end..", "end..", "end."),
    ("no<!-- c -->", "no", "no<!-- c -->."),
    ("a  b\n\tc", "a b c", "a  b\tc."),
    ("\x1ctab\x1f", "tab", "tab."),
    ('"q"\r\nline', '"q" line', "qline."),
    ("y" * 3000, "y" * 3000, "y" * 3000 + "."),
    ("é ü</Ünder x>", "é ü", "é ü."),
    ("1 < 2 > 0", "1 0", "1 < 2 > 0."),
    ("&copy &notit;", "© ¬it;", "© ¬it;."),
]
TEXTS = [c[0] for c in CASES]


def column(spark, values, expr, ddl="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, t {ddl}")
    return [r["o"] for r in df.select("i", expr.alias("o")).orderBy("i").collect()]


def test_review_cleaning(spark):
    assert column(spark, [*TEXTS, None], text.clean_review("t")) == [*[c[1] for c in CASES], ""]


def test_encoder_cleaning(spark):
    assert column(spark, TEXTS, text.clean_for_encoder("t")) == [c[2] for c in CASES]
    short = ["y" * 1998, "y" * 1999, "y" * 2000]
    assert column(spark, short, text.clean_for_encoder("t", limit=2000)) == ["y" * 1998 + ".", "", ""]
    lists = [TEXTS[:4], [], ["a..", "b.."], [TEXTS[4], TEXTS[14]]]
    wanted = ["  plain ac d.", ".", "a.. b.", "x &quot; y &amp; z é ü."]
    assert column(spark, lists, text.clean_list_for_encoder("t"), "array<string>") == wanted
    assert column(spark, [{"k": "v..", "l": "<b>w</b>"}], text.clean_map_for_encoder("t"), "map<string,string>") in (["k v.. l w."], ["l w k v."])


def test_only_references_leave_the_texts_to_be_decoded(spark):
    odd = ["&amp;&lt;", "&copy=1 &", "&&amp;;", "&#10;&NewLine;x", "&#31;&#x1e;|&#xD800;", "&\x1famp;\x1e0\x1f1", "&am\x1fp;&amp\x1e", "\U0001f600&#128512;",
           "&" + "x" * 40 + ";", "&amp" + "y" * 40, "a&#x26b", "$1\\&gt;", "", "no more", "&#9999999999;\r\n&eacute;"]
    assert column(spark, [*odd, None], text.unescape("t")) == [*map(html.unescape, odd), None]
    for made in (text.clean_for_encoder("t"), text.clean_review("t"), text.clean_map_for_encoder(F.create_map(F.lit("k"), "t"))):
        plan = spark.createDataFrame([("x",)], "t string").select(made.alias("o"))._jdf.queryExecution().executedPlan().toString()
        sent = re.findall(r"EvalPython \[(.*)", plan)
        assert sent and all("regexp_extract_all" in s for s in sent), plan


def test_titles(spark):
    titles = [None, "", "  ", 'x <span id="a">', " ".join("w" * 21), "a", '"Quoted &amp; co"', " ".join(["w"] * 20), " ".join(["w"] * 21)]
    assert column(spark, titles, text.title_present("t")) == [False, False, False] + [True] * 6
    assert column(spark, titles, text.title_strict("t")) == [False, False, False, False, False, False, True, True, False]
    assert column(spark, ['"Quoted &amp; co"'], text.clean_title("t")) == ["Quoted & co"]


def test_item_text(spark):
    df = spark.createDataFrame([("A.", "<b></b>"), ("y" * 2500, "z" * 2500)], "a string, b string")
    assert [r[0] for r in df.select(text.item_text("a", "b", 2000)).collect()] == ["A. .", "unknown item"]
    assert [r[0] for r in df.select(text.item_text("a", "b")).collect()] == ["A. .", "y" * 2500 + ". " + "z" * 2500 + "."]


def test_categories_and_brand(spark):
    raw = ['[["A ", "b</span>"], ["C"]]', '["x", "y "]', None, "[]"]
    assert column(spark, raw, text.join_categories(text.parse_categories("t"))) == ["A,C", "x,y", "", ""]
    assert column(spark, ["by\n  Acme ", "Acme"], text.clean_brand("t")) == ["Acme", "Acme"]


def test_descriptions(spark):
    rows = [None, "", "  ", "plain", "['a']", "['', 'bb', 'cc']", "[]", "[broken", '["x", "it\'s"]', "['it\\'s']"]
    assert column(spark, rows, prompts.longest_description("t", F.lit("T"))) == ["T", "T", "T", "plain", "a", "bb", "T", "[broken", "it's", "it's"]
    assert column(spark, rows, prompts.first_description("t")) == [None, "", "  ", "plain", "a", "", "[]", "[broken", "x", "it's"]


def test_track_titles(spark):
    got = column(spark, [None, 0, 59, 210], text.track_title(F.lit("i_7"), F.col("t")), "int")
    assert got == ["Track i_7", "Track i_7 - 0 min 0 sec", "Track i_7 - 0 min 59 sec", "Track i_7 - 3 min 30 sec"]


def test_answers(spark):
    assert column(spark, ['"a"\n', " a ", "ab"], text.same_answer("t", F.lit("a"))) == [True, True, False]
    assert column(spark, ["x Response:\n y Response:\n z\n", "none "], text.after_response("t")) == ["z", "none"]
    assert column(spark, ["a<|im_end|>b<|endoftext|>"], text.drop_end_markers("t")) == ["ab"]


def test_names(spark):
    assert column(spark, ["Books", "Other"], text.lookup_name(F.col("t"), text.CATEGORY_PHRASES)) == ["books", "Other"]
    assert column(spark, ["Games"], text.lookup_name(F.col("t"), text.REVIEW_CATEGORY_NAMES)) == ["Video_Games"]


def test_word_drop_is_repeatable(spark):
    words = [" ".join(f"w{i}" for i in range(200))] * 2
    a = column(spark, words, text.drop_words("t", "i", 0.3))
    assert a == column(spark, words, text.drop_words("t", "i", 0.3)) and a[0] != a[1]
    assert 100 < len(a[0].split()) < 180 and column(spark, words, text.drop_words("t", "i", 0.0)) == words


def test_arrays(spark):
    lists = [[], [1], [1, 2, 3, 4]]
    assert column(spark, lists, arrays.keep_last("t", 3), "array<int>") == [[], [1], [2, 3, 4]]
    assert column(spark, lists, arrays.pad_right("t", 3, F.lit(9)), "array<int>") == [[9, 9, 9], [1, 9, 9], [2, 3, 4]]
    kept, mask = arrays.until_end_token("t", F.lit(3))
    assert column(spark, lists, kept, "array<int>") == [[], [1], [1, 2, 3]]
    assert column(spark, lists, mask, "array<int>") == [[], [1], [1, 1, 1, 0]]
    bad = [[float("nan"), 1.0, float("inf"), float("-inf")]]
    assert column(spark, bad, arrays.sanitize("t"), "array<float>") == [[0.0, 1.0, 0.0, 0.0]]
    assert column(spark, [[0.0, 0.0]], arrays.cosine("t", "t"), "array<double>") == [0.0]


def test_tokens(spark):
    codes = [[1, 2, 3], [0, 0, 0, 4]]
    assert column(spark, codes, sids.sid(sids.tokens("t")), "array<int>") == ["<a_2><b_3><c_4>", "<a_1><b_1><c_1><d_5>"]
    assert column(spark, codes, sids.sid(sids.tokens("t", 0, sids.PIPE_TOKEN)), "array<int>") == ["<|a_1|><|b_2|><|c_3|>", "<|a_0|><|b_0|><|c_0|><|d_4|>"]
    assert column(spark, ["<a_2><b_3>", "<|a_1|><|b_12|>"], sids.parse_sid("t")) == [["<a_2>", "<b_3>"], ["<|a_1|>", "<|b_12|>"]]
    assert column(spark, [["x", "y"], ["x", "y", "z", "w"]], sids.sid_prefix("t"), "array<string>") == [None, "xyz"]
    packed = [[0b01000101, 0b00000110]]  # 9-bit words 69+512*... little-endian
    assert column(spark, packed, sids.unpack(sids.pack("t"), 4, 3), "array<int>") == [[5, 4, 6]]


@pytest.mark.parametrize("template,want", [("a {x} b {x}", "a % b %"), ("{x}", "%"), ("none", "none")])
def test_fill(spark, template, want):
    assert column(spark, ["%"], prompts.fill(template, x=F.col("t"))) == [want]


def test_list_elements_may_hold_the_delimiter(spark):
    rows = [(["a\x1fb", "c\x1e1&amp;", "\x1e0\x1f"],), (["x", None, "y"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "t array<string>").coalesce(1).select(text.clean_list_for_encoder("t")).collect()]
    assert got == ["a\x1fb c\x1e1& 0.", "x y."]
