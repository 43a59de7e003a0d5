"""Templates against what they must give, row by row."""

import pytest
from pyspark.sql import functions as F

from skein.functions.templates import TemplateError, render

SCHEMA = "name string, n int, ok boolean, tags array<string>, items array<struct<id: int, title: string, sub: array<int>>>, owner struct<name: string, tier: struct<code: string>>"
ROWS = [
    ("Siti", 3, True, ["a", None, "c"], [(1, "one", [1, 2]), (2, None, [])], ("Nur", ("gold",))),
    (None, 0, None, None, [], None),
    ("", -1, False, [], None, (None, None)),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1)


@pytest.mark.parametrize(
    ("template", "wanted"),
    [
        ("Hi {{ name }}!{# no #} {{n}}", ["Hi Siti! 3", "Hi ! 0", "Hi ! -1"]),
        ("{{ name | default('x') }} {{ name | default('x', true) | upper }}", ["Siti SITI", "x X", " X"]),
        ("{{ owner.name }}/{{ owner.tier.code | default('-') }}", ["Nur/gold", "/-", "/-"]),
        ("{{ tags | join(', ') }};{{ tags | length }};{{ tags | first }};{{ tags | last }}", ["a, , c;3;a;c", ";0;;", ";0;;"]),
        ("{% for t in tags %}{{ loop.index }}/{{ loop.length }}:{{ t }}{% if not loop.last %}, {% endif %}{% else %}none{% endfor %}", ["1/3:a, 2/3:, 3/3:c", "none", "none"]),
        ("{% for i in items -%}\n  [{{ i.id }} {{ i.title | default('?') }}{% for s in i.sub %} {{ loop.index0 }}={{ s }}{% endfor %}]\n{%- endfor %}", ["[1 one 0=1 1=2][2 ?]", "", ""]),
        ("{{ items | join('+', attribute='title') }}", ["one+", "", ""]),
        ("{% if n > 2 and ok %}big{% elif n == 0 or name %}zero{% else %}rest{% endif %}", ["big", "zero", "rest"]),
        ("{% if name %}n{% endif %}{% if tags %}t{% endif %}{% if ok == false %}f{% endif %}{% if not owner %}o{% endif %}", ["nt", "o", "f"]),
        ("{% if 'a' in tags %}in{% else %}out{% endif %} {% if 'it' in name %}yes{% endif %}", ["in yes", "out ", "out "]),
        ("{{ ok }} {{ name | replace('S', 's') | tojson }} {{ items | tojson }}", None),
        ("{% if n != 3 %}{% if n < 0 %}neg{% else %}pos{% endif %}{% endif %}", ["", "pos", "neg"]),
    ],
)
def test_render(df, template, wanted):
    got = [r[0] for r in df.select(render(df, template)).collect()]
    if wanted is None:
        assert got[0] == 'True "siti" [{"id":1,"title":"one","sub":[1,2]},{"id":2,"sub":[]}]'
    else:
        assert got == wanted


@pytest.mark.parametrize(
    "template",
    ["{{ nobody }}", "{{ owner.age }}", "{{ name | shout }}", "{{ tags }}", "{% for x in name %}{% endfor %}", "{% if n %}", "{% for t in tags %}", "{% odd %}", "{{ name | }}", "{{ name | join }}", "{{ items | join(',', attribute='none') }}", "{{ name | replace('a') }}", "{{ name | default }}", "{{ t }}{% for t in tags %}{% endfor %}", "{{ f(name) }}"],
)
def test_errors_come_when_compiled(df, template):
    with pytest.raises(TemplateError):
        render(df, template)


def test_named_values(df):
    got = df.select(render(df, "{{ who }}-{{ many }}", who="name", many=F.size("tags"))).first()[0]
    assert got == "Siti-3"
    with pytest.raises(TemplateError):
        render(df, "{{ name }}", who="name")
