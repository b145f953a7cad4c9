"""Tokens against the public library, sentences against marked texts, mixing against its rules."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import mixing, tokens
from docloom.llm.sentences import sentence_spans, sentences

JSON = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "it's we'll  \n\n x", "<|endoftext|>", "运维团队应当先检查审计日志，再处理", "👩‍💻🛡️ ٣٤ कृपया", "a" * 5000, "ab" * 3000, "Ω≈√‮abc‬​", "�\x00\x7f"]


@pytest.mark.parametrize("text", TEXTS)
def test_tokens_equal_the_library(library, text):
    assert tokens.vocabulary().encode(text) == library(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_and_append(library, text):
    words = tokens.vocabulary()
    assert words.encode(text) == library(text)
    grown = tokens.EncodedText(words)
    for i in range(0, len(text), 7):
        grown.append(text[i : i + 7])
    assert grown.tokens() == words.encode(text)


def test_edits_recompute_locally():
    words, rng = tokens.vocabulary(), random.Random(4)
    data = b"an unremarkable string without spaces".replace(b" ", b"") * 200
    tree = tokens.PrefixTable(words, data)
    for _ in range(30):
        at = rng.randrange(len(tree.data))
        done = tree.replace(at, min(len(tree.data), at + rng.randrange(4)), rng.choice([b"", b"q", b"the", b"\xff"]))
        assert done < 600
        assert tree.tokens() == tokens.PrefixTable(words, tree.data).tokens()


def test_encoded_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in tokens.encoded(df).collect())
    assert got == [(1, []), (2, []), (3, library("hello world")), (3, library("hello world"))]
    assert tokens.encoded(df.limit(0)).isEmpty()


MARKED = [
    "Dr. Cato of Othium Labs Inc. said no.|See Fig. 3 and No. 57 for it.|Upgrade to v. 9.6.2, i.e. the build, by 5 p.m. on Monday.|It is due at 9 a.m.|J. K. Bryhol left.",
    "They took the driver, etc.|35 of 44 checks ran.|xZenvex agents came.|Who did it?!|They waited...|Then the router … then it stopped.",
    "One.|Two words here.Three more words.|Edit mir_oro.yaml and fetch https://a.example/x?v=9 with runner.js 1.2.3 now.".replace("here.Three", "here.|Three"),
    "“The key is out. Patch it now!” said Ysolde.|‘Never trust a proxy.’|Emeric left.|\"Why did it fail?\" asked Runa.|(The vault was fine.)|The log (cf. the list, approx. 16 cases) grew.",
    "Am 3. März kam z. B. Agenten.|Siehe Abs. 36 bzw. Nr. 60 usw.|Ohne Filter (vgl. S. 29) nichts.|„Alles offen. Bitte handeln!“, sagte Bexa.",
    "M. Brywex et Mme Tav ont lu l'art. 24 et la p. 72.|Les modèles… puis les index.|« Vite ! Oui », a dit Ivo.|Sûr ?|Oui.",
    "EE. UU. revisó la pág. 29.|El Sr. Sarnoro vino.|«¡Ya! No espere», dijo Runa.|¡Bien!|¿Sí?",
    "Проф. Vextav описал, т. е. агенты.|В 2025 г. Zencyr пришла.|«Все открыты. Закройте!» — сказал Ivo.",
    "Ο κ. Brygral έλεγξε τα μοντέλα.|Είναι ασφαλή;|Ναι.",
    "قال د. Bexa إن النموذج معزول.|هل ما زال آمنا؟|«السجل قديم. حدثوه فورا!»، هكذا قال Ivo.",
    "डॉ. Cato ने लॉग को हटाया।|“खुला है। सुधारें!”, Nilo ने कहा।|अंक 16.7 से 38.1 हो गया।",
    "Pelcyr表示：“已被镜像。请立即升级！”|版本5.14.2的评分为31.6。|所谓“推理队列！”问题已被重建。|停止响应……随后泄露。|（尚未修补。）|约有89家。",
    "Iumは「監査は危険だ。すぐ直せ！」と述べた。|通信路は……やがて直した。|（対象外である。）|安全か？",
    "รุ่นใหม่ของ Torsarn Guard 2.16.0 แก้ไขบัญชีแล้ว|รายงานฉบับนี้ จำนวน 37 รายการ".replace("ฉบับนี้ จำ", "ฉบับนี้จำ"),
]


@pytest.mark.parametrize("marked", MARKED)
@pytest.mark.parametrize("space", [" ", "\n", "  "])
def test_sentences(marked, space):
    parts = marked.split("|")
    text, spans = "", []
    for i, p in enumerate(parts):
        text += (space if i and not (p[0] > "　" or text[-1] in "。？！”」") else "") + ""
        spans.append((len(text), len(text) + len(p)))
        text += p
    assert [text[a:b] for a, b in sentence_spans(text)] == [text[a:b] for a, b in spans]


def test_paragraphs_lists_and_unclosed_quotes():
    text = "A heading\r\n \r\n1. First entry.\r\n\r\n- second\nwraps “never closed.\n\n* “third. Still.” Next one.\n\n　　Last (open. Then more."
    assert [text[a:b] for a, b in sentence_spans(text)] == ["A heading", "1. First entry.", "- second\nwraps “never closed.", "* “third. Still.”", "Next one.", "Last (open.", "Then more."]
    assert sentence_spans("") == sentence_spans(" \n\t　 ") == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB1 .!?\n\r\t“”\"'()«»。，…:;。กข่ -*​", max_size=80))
def test_every_character_is_in_exactly_one_sentence(text):
    at = 0
    for a, b in sentence_spans(text):
        assert a >= at and b > a and not text[at:a].strip() and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


def test_long_text_takes_linear_time():
    import time

    took = []
    for n in (2_000, 8_000):
        text = ("a.b" * n) + " " + "x(" * n + " “" * n + ". " * n + "แ " * n
        start = time.perf_counter()
        sentence_spans(text)
        took.append(time.perf_counter() - start)
    assert took[1] < 12 * took[0] + 0.5


def test_sentence_rows(spark):
    df = spark.createDataFrame([(1, "One. Two.", "x"), (2, None, "x"), (3, " ", "x")], "doc_id long, text string, start_pos string")
    assert [tuple(r) for r in sentences(df).collect()] == [(1, 0, 4), (1, 5, 9)]
    assert sentences(df.limit(0)).isEmpty()


def sizes(spark, n, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaaaabbc"), rng.randrange(50, 150), "x") for i in range(n)] + [(9001, None, 5, "x"), (9002, "a", 0, "x"), (9003, "unwanted", 10, "x")]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long, copy string")


def targets(spark, *rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "source string, target_share double, max_repeats int, share string")


def test_mixture_keeps_shares_and_caps(spark):
    df = sizes(spark, 3000)
    mixture, report = mixing.mix(df, targets(spark, ("a", 0.3, 1), ("b", 0.2, 2), ("c", 0.4, 3), ("absent", 0.1, 5)))
    shares = {r.source: r for r in report.collect()}
    assert shares["absent"].tokens == 0 and shares["absent"].share == 0
    for source, share in (("a", 3 / 9), ("b", 2 / 9), ("c", 4 / 9)):
        assert abs(shares[source].share - share) < 0.004
        assert shares[source].uses <= shares[source].max_repeats
    rows = mixture.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.source in "abc" and r.tokens > 0 for r in rows)
    total = df.filter("source = 'c'").agg(F.sum("tokens")).head()[0]
    assert shares["c"].tokens > 2.9 * total  # the scarcest source is used up


def test_mixture_order_equals_plain_queueing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)
    df, goals = sizes(spark, 400), [("a", 0.5, 2), ("b", 0.5, 3)]
    mixture, _ = mixing.mix(df, targets(spark, *goals), budget=20_000)
    drawn = df.withColumn("h", F.xxhash64(F.lit(1), "doc_id")).filter("source IN ('a', 'b') AND tokens > 0").collect()
    copies = []
    for source, share, most in goals:
        own = sorted((r for r in drawn if r.source == source), key=lambda r: (r.h, r.doc_id))
        upto = 0
        for _ in range(most):
            for r in own:
                upto += r.tokens
                copies.append((upto / share, source, r.doc_id, r.tokens))
    uses, total = {}, 0
    for _, _, doc, n in sorted(copies):
        total += n
        if total > 20_000:
            break
        uses[doc] = uses.get(doc, 0) + 1
    assert {r.doc_id: r.uses for r in mixture.collect()} == uses


def test_mixture_of_nothing(spark):
    mixture, report = mixing.mix(sizes(spark, 5).limit(0), targets(spark, ("a", 1.0, 1), (None, 0.5, 1), ("b", None, None)))
    assert mixture.isEmpty() and [r.share for r in report.collect()] == [0.0, 0.0, 0.0]


def test_library_file_is_the_same_vocabulary():
    vocab = json.load(open(JSON))["model"]["vocab"]
    assert len(vocab) == len(tokens.vocabulary().ids)


def test_registered_mixture_of_all_tokens_reports_shares_below_target(spark, tmp_path):
    from docloom.llm import queries

    rows = [(i, "some words of one document " * 5, "large") for i in range(60)] + [(100, "one short text", "tiny")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    targets(spark, ("large", 0.5, 2), ("tiny", 0.5, 3)).write.parquet(f"{tmp_path}/mix_targets.parquet")
    assert queries.QUERIES["p9_mix"](spark, str(tmp_path)).filter("source = 'large'").count() < 3
    shares = {r.source: r for r in queries.QUERIES["p9_whole_shares"](spark, str(tmp_path)).collect()}
    assert shares["tiny"].uses == 3 and 0 < shares["tiny"].share < 0.05
    assert shares["large"].documents == 60 or shares["large"].documents == 59
    assert queries.QUERIES["p9_whole_mix"](spark, str(tmp_path)).count() >= 60


def test_every_sentence_terminal_ends_a_sentence():
    import regex

    from docloom.llm.sentences import sentence_spans

    every = regex.findall(r"\p{Sentence_Terminal}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    assert len(every) > 160
    for mark in every:
        text = f"Something happened{mark} Nothing followed{mark}"
        assert sentence_spans(text) == [(0, 19), (20, 37)], hex(ord(mark))


def test_abbreviations_by_language_and_context():
    from docloom.llm.sentences import sentence_spans

    def split(text, lang=None):
        return [text[a:b] for a, b in sentence_spans(text, lang)]

    assert split("I chose plan B. Then we left.") == ["I chose plan B.", "Then we left."]
    assert split("He lives on Main St. She left.") == ["He lives on Main St.", "She left."]
    assert split("J. Smith met Dr. Who on St. Mary Ave. in May.") == ["J. Smith met Dr. Who on St. Mary Ave. in May."]
    assert split("We see the vgl. Here it ends.", "en") == ["We see the vgl.", "Here it ends."]  # an abbreviation in German only
    assert split("Das ist neu, vgl. Abschnitt eins.", "de") == split("Das ist neu, vgl. Abschnitt eins.", "en") == ["Das ist neu, vgl. Abschnitt eins."]  # a wrong name isn't believed


def test_nesting_and_words_have_no_bound():
    from docloom.llm.sentences import sentence_spans

    deep = "(«" * 300 + "One. Two." + "»)" * 300
    assert sentence_spans(f"Start {deep} goes on. Next.") == [(0, 1224), (1225, 1230)]
    long = "x" * 5000
    assert sentence_spans(f"{long}. {long.title()}.") == [(0, 5001), (5002, 10003)]
