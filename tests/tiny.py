"""Tiny graphs: two people sites, and two people-and-cars sites."""

A, B = "http://a.example", "http://b.example"


def _rows(host, facts):
    rows = []
    for s, p, o in facts:
        o = f'"{o[1:]}"' if o.startswith("=") else f"<{host}/entity/{o}>"
        rows.append((f"<{host}/entity/{s}>", f"<{host}/relation/{p}>", o))
    return rows


PEOPLE1 = _rows(A, [
    ("person1", "worksFor", "person2"), ("person1", "livesIn", "city1"), ("person1", "worksIn", "city2"),
    ("person2", "livesIn", "city2"), ("person2", "worksIn", "city2"), ("person1", "has#name", "=John"),
    ("person2", "has#name", "=Moley"),
]) + [
    (f"<{A}/entity/city2>", f"<{B}/relation/has#name>", '"Bonn"'),
    (f"<{A}/entity/city1>", f"<{B}/relation/has#name>", '"Cologne"'),
]
PEOPLE2 = _rows(B, [
    ("person3", "worksFor", "person4"), ("person3", "livesIn", "place1"), ("person3", "worksIn", "place2"),
    ("person4", "livesIn", "place2"), ("person4", "worksIn", "place2"), ("person3", "has#name", "=John"),
    ("place2", "has#name", "=Bonn"), ("place1", "has#name", "=Cologne"),
])
CARS1 = _rows(A, [
    ("person1", "worksFor", "person2"), ("person1", "livesIn", "city1"), ("person1", "worksIn", "city2"),
    ("person2", "livesIn", "city2"), ("person2", "worksIn", "city2"), ("person1", "has#name", "=John"),
    ("person2", "has#name", "=Moley"), ("person1", "has#lastName", "=Leon"), ("person2", "has#lastName", "=Lion"),
    ("city2", "has#name", "=Bonn"), ("city1", "has#name", "=Cologne"), ("car1", "worksFor", "person2"),
    ("car1", "registeredIn", "city1"), ("car1", "madeIn", "city2"), ("car2", "registeredIn", "city2"),
    ("car2", "madeIn", "city2"), ("car1", "has#name", "=Benz"), ("car2", "has#name", "=BMW"),
    ("car1", "has#plate", "=1212"), ("car2", "has#plate", "=1556"),
])
CARS2 = _rows(B, [
    ("person3", "worksFor", "person4"), ("person3", "livesIn", "place1"), ("person3", "worksIn", "place2"),
    ("person4", "livesIn", "place2"), ("person4", "worksIn", "place2"), ("person3", "has#name", "=John"),
    ("place2", "has#name", "=Bonn"), ("person3", "has#lastName", "=Leon"), ("person4", "has#lastName", "=Lion"),
    ("place1", "has#name", "=Cologne"), ("car3", "worksFor", "person4"), ("car3", "registeredIn", "place1"),
    ("car3", "madeIn", "place2"), ("car4", "registeredIn", "place2"), ("car4", "madeIn", "place2"),
    ("car3", "has#name", "=Benz"), ("car4", "has#name", "=BMW"), ("car3", "has#plate", "=1212"),
    ("car4", "has#plate", "=1556"),
])


def triples(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string")


def short(pairs):
    return {tuple(x.strip("<>").split("/")[-1] for x in p) for p in pairs}
