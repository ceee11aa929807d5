"""A whole run, and its command line: python -m lakeforge.plans.run."""

from __future__ import annotations

import argparse
import logging
from dataclasses import fields

from pyspark.sql import SparkSession

from ..operators.parse import catalog_entries
from ..operators.state import StateStore, record_count, reset_status, save_catalog, sync_queue
from ..schemas import IN_PROGRESS, PENDING
from ..session import cut_lineage, local_session, scoped_tables, ship
from ..sources.replies import ReplyLog
from ..sources.scan import source_files
from . import audit, graph
from .config import Config
from .infer import HttpModel, Model


log = logging.getLogger(__name__)


def run(spark: SparkSession, config: Config, model: Model | None = None) -> StateStore:
    """Catalog, first pass, reviews. Answers of the model lie in a log beside the state until the pass that asked for them has stored its
    results, so a run that breaks off at any place goes on where it was."""
    ship(spark)
    model = model or HttpModel(config.endpoint, config.model)
    store = StateStore(spark, config.state_dir)
    answers = ReplyLog(spark, f"{config.state_dir.rstrip('/')}/answers")
    with scoped_tables(spark):
        files = cut_lineage(source_files(spark, config.root), "files")
        entries = cut_lineage(catalog_entries(files), "entries")
        log.info("catalog entries found: %d in %d files", entries.count(), files.count())
        catalog = cut_lineage(save_catalog(store.read("catalog"), entries), "catalog")
        functions = reset_status(sync_queue(store.read("functions"), catalog), IN_PROGRESS, PENDING)
        store.commit(catalog=catalog, functions=functions)
        log.info("functions stored: %d", record_count(store.read("functions")))
        graph.run_pass(store, files, model, config, answers)
        audit.run_passes(store, files, model, config, answers)
    return store


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Catalog a Go source tree, summarise its functions and review them.")
    for f in fields(Config):
        name, default = f"--{f.name.replace('_', '-')}", f.default
        parser.add_argument(name, default=default, **({"action": "store_true"} if isinstance(default, bool) else {"type": type(default)}))
    config = Config(**vars(parser.parse_args(args)))
    logging.basicConfig(filename=config.log_file or None, level=logging.INFO)
    run(local_session(), config).close()


if __name__ == "__main__":
    main()
