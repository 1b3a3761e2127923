"""What a query read, from Spark's own record of it."""


def rows_read(spark, action) -> int:
    """Rows that Parquet scans gave out while ``action`` ran: those of the row groups that weren't skipped."""
    bus = spark.sparkContext._jsc.sc().listenerBus()
    store = spark._jsparkSession.sharedState().statusStore()
    bus.waitUntilEmpty(10_000)
    before = store.executionsCount()
    action()
    bus.waitUntilEmpty(10_000)
    total = 0
    runs = store.executionsList()
    for k in range(before, runs.size()):
        run = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            if node.name().startswith("Scan parquet"):
                for j in range(node.metrics().size()):
                    metric = node.metrics().apply(j)
                    if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                        total += int(values.apply(metric.accumulatorId()).replace(",", ""))
    return total
