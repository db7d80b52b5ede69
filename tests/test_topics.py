"""Topics of an index by a tree of model calls, and searches of roots that a registered data source gives."""

import json
import sys

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql.datasource import DataSource, DataSourceReader

from docloom import api
from docloom.operators import review
from docloom.operators.answers import AnswerStore

register_pickle_by_value(sys.modules[__name__])  # tasks can't import this module


def by_first_letter(prompts):
    """Groups names by their first letter; topics by nothing but their own letter again."""
    out = []
    for prompt in prompts:
        assert len(prompt) < 700
        names = [line[2:].split(":")[0] for line in prompt.split("\n")[2:]]
        groups = {}
        for n in names:
            groups.setdefault(f"Topic {n.removeprefix('Topic ')[0]}", []).append(n)
        clusters = [{"topic": t, "paths": p} for t, p in groups.items()] + [{"topic": "Late", "paths": names[:1] + ["never.md"]}]
        out.append(json.dumps({"clusters": clusters}))
    return out


def test_topics_of_many_summaries(spark):
    rows = [(f"{'abc'[i % 3]}{i}.md", "words " * 5) for i in range(120)]
    summary = spark.createDataFrame([*rows, ("d.md", None)], "path string, summary string")
    found = review.topics(summary, by_first_letter, "group", most_chars=500).collect()
    assert sorted((r.ord, r.topic) for r in found) == [(0, "Topic a"), (1, "Topic b"), (2, "Topic c")]
    assert {r.topic[-1]: sorted(r.paths) for r in found} == {x: sorted(p for p, _ in rows if p[0] == x) for x in "abc"}
    broken = review.topics(summary, lambda prompts: ["not json"] * len(prompts), "group", most_chars=500).collect()
    assert [(r.topic, len(r.paths)) for r in broken] == [("Pages", 120)]
    assert review.topics(summary.limit(0), by_first_letter, "group").count() == 0


def test_strays_go_to_other_and_answers_are_kept(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "x"), ("b.md", "y")], "path string, text string")
    model = lambda prompts: [json.dumps({"clusters": [{"topic": "T", "paths": ["a.md"]}]}) if p.startswith("group") else "S" for p in prompts]
    store = AnswerStore(spark, str(tmp_path / "answers"))
    text = api.index(docs, model, "sum", clustered=True, topics="group", cache=store).first().text
    assert text == "# Index\n\n## T\n\n- **[a](a.md)** — S\n\n## Other\n\n- **[b](b.md)** — S\n"
    assert api.index(docs, lambda prompts: 1 / 0, "sum", clustered=True, topics="group", cache=store).first().text == text


class Notes(DataSource):
    @classmethod
    def name(cls):
        return "notes"

    def schema(self):
        return "path string, text string"

    def reader(self, schema):
        word = self.options.get("word", "x")

        class Reader(DataSourceReader):
            def read(self, partition):
                yield "n.md", f"# Title\nthe {word} here\n"

        return Reader()


def test_search_of_a_registered_source(spark, tmp_path):
    spark.dataSource.register(Notes)
    (tmp_path / "f.md").write_text("needle in a file\n")
    roots = [
        {"path": "/notes", "mirror_name": "N", "source_type": "notes", "identifier": "n", "format": "notes", "options": {"word": "needle"}},
        {"path": str(tmp_path), "mirror_name": "F", "source_type": "files", "identifier": "f"},
    ]
    found = [(r.path.rsplit("/", 1)[1], r.line_no, r.mirror, r.title) for r in api.search(spark, "needle", roots).collect()]
    assert sorted(found) == [("f.md", 1, "F", None), ("n.md", 2, "N", "Title")]
