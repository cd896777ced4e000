"""Small hand-made tables, and looks at plans."""

from contextlib import contextmanager

from strideframe.schema import EVENT


def events(spark, stamps, domain="collector", session="s1", pressure=None, values=None):
    """Accelerometer readings (i+1, i+2, i+3) at the stamps; pressure at its own stamps or at all."""
    pressure = stamps if pressure is None else pressure
    rows = []
    for i, t in enumerate(sorted(set(stamps) | set(pressure))):
        has, p = t in stamps, (1000.0 + i if t in pressure else None)
        if values is not None:
            p = values(t)
        axes = (float(i + 1), float(i + 2), float(i + 3)) if has else (None, None, None)
        rows.append((domain, "p1", "d1", session, session, f"p1#d1#{session}", "bus", 0, "pocket", t, *axes,
                     None, None, None, None, None, None, p, i))
    return spark.createDataFrame(rows, ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in EVENT.fields) + ", seq bigint")


def values(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@contextmanager
def plain_plans(spark):
    """Plans as for tables of unknown, large size: no adaptive execution, no broadcast that is not asked for."""
    wanted = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def nodes(df):
    """All nodes of a frame's physical plan."""
    left, found = [df._jdf.queryExecution().executedPlan()], []
    while left:
        found.append(left.pop())
        children = found[-1].children()
        left += [children.apply(i) for i in range(children.size())]
    return found
