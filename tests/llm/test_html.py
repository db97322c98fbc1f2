"""Operator 8 on pages without an article element, in languages beyond the lists, and on what an article may hold."""

import re
from collections import Counter

import pytest

from quarry.llm.html_extraction import article_text

PLAN = "The plan of the city is to build a new line for the people in the north, and it was agreed on by all of the parties."
NAMES = "Anna Berg, Carl Dahl, Eva Falk, Gustav Holm, Ida Jansson, Karl Lind, Maria Nyberg, Olof Persson, Rut Sandberg, Tor Ulvaeus"
LANGUAGES = {
    "ru": ("Главная", "Заголовок", "Правительство объявило о новом плане развития городского транспорта, который должен начаться весной следующего года."),
    "zh": ("首页", "交通", "市政府宣布了一项新的城市交通发展计划，该计划将于明年春天开始实施，预计耗资数十亿元，并将持续五年时间。"),
    "pl": ("Aktualności", "Tytuł", "Władze miasta ogłosiły wczoraj nowy projekt rozbudowy komunikacji miejskiej, który ruszy wiosną przyszłego roku."),
}


@pytest.mark.parametrize("language", LANGUAGES)
def test_other_languages_without_an_article(language):
    link, title, text = LANGUAGES[language]
    links = f'<div><a href="/a">{link}</a> <a href="/b">{link}</a></div>'
    assert article_text(f"<body>{links}<h1>{title}</h1><p>{text}</p><p>{text}</p>{links}</body>").splitlines() == [title, text, text]


def test_a_sentence_that_is_mostly_a_link():
    assert article_text("<article><p>See <a href='x'>the long report of the committee</a>.</p></article>") == "See the long report of the committee."
    assert article_text(f"<article><p>{PLAN}</p><ul><li><a href='x'>Another story</a></li></ul></article>") == PLAN


def test_a_long_block_poor_in_stop_words_goes_by_its_neighbours():
    assert article_text(f"<body><p>{PLAN}</p><p>{NAMES}</p><p>{PLAN}</p></body>").splitlines() == [PLAN, NAMES, PLAN]
    links = "<div><a href='x'>One</a></div>"
    assert article_text(f"<body><p>{PLAN}</p>{links}<p>{NAMES}</p>{links}</body>") == PLAN


def test_answers_of_readers():
    answer = f'<section id="responses"><article class="response"><p>{PLAN} So I think.</p></article></section>'
    assert article_text(f"<body><article><h1>T</h1><p>{PLAN}</p></article>{answer}</body>").splitlines() == ["T", PLAN]
    assert article_text(f'<article><p>{PLAN}</p><div class="response"><p>{PLAN} I said.</p></div></article>').splitlines() == [PLAN, f"{PLAN} I said."]


@pytest.mark.parametrize("unknown", [False, True])
def test_pages_of_the_table_without_article_elements(spark, sf_dir, unknown):
    """The same pages with div in place of article, in their own language or with all letters outside of references replaced."""
    letters = str.maketrans("abcdefghijklmnopqrstuvwxyz", "фисвуапршолдьтщзйкыегмцчня")
    right = kept = wanted = 0
    for row in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        page = re.sub(r">[^<&]+<", lambda m: m[0].translate(letters), row.html or "") if unknown else row.html or ""
        want = Counter(article_text(page).split("\n"))
        got = Counter(article_text(page.replace("<article>", "<div>").replace("</article>", "</div>")).split("\n"))
        length = lambda lines: sum(len(line) * n for line, n in lines.items())
        right, kept, wanted = right + length(got & want), kept + length(got), wanted + length(want)
    assert wanted and right > 0.95 * kept and right > 0.95 * wanted
