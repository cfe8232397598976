"""The graph against a loop over records."""

from matchloom.operators import knowledge as K


def loop(mods, people):
    """One record after the other, as a dictionary would take them."""
    nodes, edges = {}, {}
    clean = lambda v: " ".join(str(v or "").split())

    def node(kind, value, **attributes):
        key = f"{kind}:" + clean(value).lower().replace(" ", "_").replace("/", "_").replace("\\", "_").replace("&", "and")
        mine = nodes.setdefault(key, {"node_type": kind})
        for a, v in attributes.items():
            if mine.get(a) in (None, ""):
                mine[a] = v
        return key

    def unit(name, colleges):
        if not clean(name):
            return None
        me = node("department", name, department_name=clean(name), label=clean(name))
        for c in colleges or []:
            if clean(c):
                edges[me, node("college", c, college_name=clean(c), label=clean(c)), "department_in_college"] = None
        return me

    def topics(me, kind, said):
        for t, s in said or []:
            if clean(t):
                edges[me, node("topic", t, topic_name=clean(t), label=clean(t)), kind] = s or 0

    for i, code, title, departments, colleges, said in mods:
        if clean(i):
            me = node("module", i, module_id=clean(i), module_code=code, module_title=title, label=title if title is not None else clean(i))
            for d in departments or []:
                if u := unit(d, colleges):
                    edges[me, u, "module_in_department"] = None
            topics(me, "module_has_topic", said)
    for i, name, position, department, college, url, said in people:
        if clean(i):
            me = node("staff", i, staff_id=clean(i), full_name=name, position=position, department_name=department, college_name=college, profile_url=url, label=name if name is not None else clean(i))
            if u := unit(department, [college]):
                edges[me, u, "staff_in_department"] = None
            topics(me, "staff_has_topic", said)
    return nodes, edges


MODS = [("m1", None, "", ["Law & Order", ""], ["Arts", None], [("Crime/Law", 3), ("crime law", 2), (None, 9)]), ("m1", "LA1", "Law", ["law & order"], [], [("crime law", None)]), (" ", "X", "Y", ["Nowhere"], ["Z"], []),
        (None, "X", "Y", [], [], []), ("m2", "", None, None, None, None), ("m3", "C", "t", ["History"], ["Arts", " arts "], [("Old  Things", 4)])]
PEOPLE = [("s1", "", None, "history", "ARTS", None, [("old things", 1), ("OLD THINGS", 7)]), ("s1", "Ann", "Reader", "", "College", "u", None), ("s2", None, "", None, "Nowhere", "", []), ("", "Bob", "", "History", "Arts", "", [])]


def test_upsert_equals_a_loop(spark):
    mods = spark.createDataFrame([(k, *r) for k, r in enumerate(MODS)], f"ord long, {K.MODULE}").repartition(4)
    people = spark.createDataFrame([(k, *r) for k, r in enumerate(PEOPLE)], f"ord long, {K.STAFF}").repartition(3)
    nodes, edges = K.build(mods, people)
    want_nodes, want_edges = loop(MODS, PEOPLE)
    got = {r["id"]: {a: r[a] for a in ("node_type", *K.ATTRIBUTES) if r[a] is not None} for r in nodes.collect()}
    assert got == {k: {a: v for a, v in x.items() if v not in (None, "")} for k, x in want_nodes.items()}
    assert {(r["source"], r["target"], r["edge_type"]): r["topic_score"] for r in edges.collect()} == want_edges
    assert len({x["node_type"] for x in got.values()}) == 5 and len({k[2] for k in want_edges}) == 5
    none = K.build(mods.limit(0), people.limit(0))
    assert none[0].count() == 0 and none[1].count() == 0


def test_records_are_dealt_in_small_files(spark, monkeypatch):
    monkeypatch.setattr(K, "DEALT", 5)
    modules = spark.range(0, 40, 1, 1).selectExpr("id as ord", "string(id) as module_id", "'a' as module_code", "'t' as module_title", "array('law') as departments", "array('arts') as colleges", "array(struct('x' as topic, 1 as score)) as topics")
    staff = spark.range(0, 10, 1, 1).selectExpr("id as ord", "string(id) as staff_id", "'n' as full_name", "'Reader' as position", "'law' as department_name", "'arts' as college_name", "'' as profile_url", "array(struct('x' as topic, 1 as score)) as topics")
    nodes, edges = K.build(modules, staff)
    assert len(nodes.inputFiles()) == 8 + 2 and nodes.count() == 40 + 10 + 3 and edges.count() == 80 + 1 + 20
