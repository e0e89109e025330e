"""What the driver's JVM has freed goes back to the system."""

from textmill.llm import shared


def test_release_returns_the_free_heap(spark):
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kept = [gateway.new_array(jvm.long, 6_000_000) for _ in range(12)]
    run = jvm.java.lang.Runtime.getRuntime()
    for a in kept:
        gateway.detach(a)
    del kept, a
    before = run.totalMemory()
    shared.release(spark)
    assert run.totalMemory() < before and run.freeMemory() < 0.35 * run.totalMemory()
    # The settings are what they were: a plain collection may keep seven tenths free.
    jvm.System.gc()
    beans, named = jvm.java.lang.management.ManagementFactory, jvm.java.lang.Class.forName
    kind = "com.sun.management.HotSpotDiagnosticMXBean"
    types, values = gateway.new_array(jvm.java.lang.Class, 1), gateway.new_array(jvm.java.lang.Object, 1)
    for name, value in (("MinHeapFreeRatio", "40"), ("MaxHeapFreeRatio", "70")):
        types[0], values[0] = named("java.lang.String"), name
        assert named(kind).getMethod("getVMOption", types).invoke(beans.getPlatformMXBean(named(kind)), values).getValue() == value
