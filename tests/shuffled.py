"""What the stages run so far wrote to shuffles."""


def shuffled(spark) -> tuple[int, int]:
    """Rows and bytes."""
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = list(jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(
        None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())))
    return sum(s.shuffleWriteRecords() for s in stages), sum(s.shuffleWriteBytes() for s in stages)
