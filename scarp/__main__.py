"""python -m scarp embed|analyze|compare CONFIG"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from scarp.plans import pipelines
from scarp.sources.datasets import load_config


def main(args: list[str]) -> int:
    if len(args) != 2 or args[0] not in ("embed", "analyze", "compare"):
        print(__doc__, file=sys.stderr)
        return 2
    try:
        config = load_config(args[1])
        spark = SparkSession.builder.appName("scarp").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if args[0] == "compare":
            pipelines.compare(spark, config["configs"], config.get("output_dir", f"results/{config.get('name', 'comparison')}"))
        else:
            print(getattr(pipelines, args[0])(spark, config))
    except (FileNotFoundError, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
