"""python -m ledgerfold ROOT put KEY VALUE | get KEY | delete KEY | cas KEY EXPECTED NEW ("-": absent) | scan [START [END]]

Exit codes: 0 done, 3 no such key, 4 the comparison failed, 5 another writer came first (nothing was
written), 2 wrong usage, 1 any other failure.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from ledgerfold.store import Conflict, Store


def main(args: list[str], spark: SparkSession | None = None) -> int:
    counts = {"put": {2}, "get": {1}, "delete": {1}, "cas": {3}, "scan": {0, 1, 2}}
    if len(args) < 2 or len(args) - 2 not in counts.get(args[1], ()):
        print(__doc__, file=sys.stderr)
        return 2
    root, command, *rest = args
    spark = spark or SparkSession.builder.appName("ledgerfold").getOrCreate()
    store = Store(spark, root)
    try:
        if command == "get":
            value = store.get(spark.createDataFrame([(rest[0],)], "key string")).first()["value"]
            if value is None:
                return 3
            print(value)
        elif command == "scan":
            for row in store.scan(*rest).toLocalIterator():
                print(f"{row['key']}\t{row['value']}")
        elif command == "cas":
            expected = None if rest[1] == "-" else rest[1]
            swap = spark.createDataFrame([(rest[0], expected, rest[2])], "key string, expected string, value string")
            return 0 if store.cas(swap).first()["applied"] else 4
        else:
            value = rest[1] if command == "put" else None
            store.write(spark.createDataFrame([(rest[0], value)], "key string, value string"))
    except Conflict:
        return 5
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
