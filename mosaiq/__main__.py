"""``python -m mosaiq --config FILE [--flag value ...]``: the run that settings describe, on the session that Spark's own settings name."""

import sys

from pyspark.sql import SparkSession

from mosaiq.config import from_arguments, log, set_log_level
from mosaiq.plans import program


def main(args: list[str]) -> int:
    settings = from_arguments(args)
    set_log_level(settings.log_level)
    if not settings.input_directory or not settings.output_directory:
        log.error("input_directory and output_directory must be set")
        return 1
    for name in program.run(SparkSession.builder.appName("mosaiq").getOrCreate(), settings):
        print(name)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
