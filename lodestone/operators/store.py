"""The versioned store: tables in a folder, ingest runs, batch upserts, reindexing, export.

A run writes each table anew beside the old one and then commits all of them by
one small file with the next number, so readers see either the old or the new
state, and a lost executor only repeats its tasks.
"""

from __future__ import annotations

import json
import tarfile
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..adapters import CONCEPT_SQL, concepts
from ..plans.registry import Registry
from ..sources.parsers import file_system
from .relational import snapshot_diff
from .retrieval import add_edges, embed, replace_edges
from .temporal import record_facts, replace_concepts, upsert_concepts

registry = Registry()
query = registry
TABLES = {"concept": schemas.CONCEPT, "embedding": schemas.EMBEDDING, "edge": schemas.EDGE, "fact": schemas.FACT, "epoch": schemas.EPOCH}
#: Message definitions known without a source: id, family, title, summary, intent terms, key fields, related messages.
MESSAGES = (
    (
        "pacs.008", "pacs", "FI to FI Customer Credit Transfer",
        "Credit transfer between financial institutions on behalf of a customer — the Pix payment order itself.",
        "credit transfer interbank settlement, customer credit transfer, FI to FI, transferência de crédito interbancária, ordem de pagamento Pix, liquidação interbancária",
        ("InstgAgt — instructing agent (ISPB)", "InstdAgt — instructed agent (ISPB)", "IntrBkSttlmAmt — settlement amount", "EndToEndId — end-to-end identifier", "ChrgBr — charge bearer"),
        ("pacs.002", "pacs.004"),
    ),
    (
        "pacs.002", "pacs", "FI to FI Payment Status Report",
        "Status of a payment instruction: accepted, rejected, pending, or settled. Pix confirmation/rejection.",
        "payment status report, transaction status, accepted rejected pending settled, relatório de status de pagamento, confirmação rejeição Pix",
        ("OrgnlEndToEndId — original e2e id", "TxSts — transaction status (ACSC/RJCT/...)", "StsRsnInf — status reason"),
        ("pacs.008",),
    ),
    (
        "pacs.004", "pacs", "Payment Return",
        "Return of funds after settlement — used for Pix devolução (refund).",
        "payment return, reversal of funds, refund after settlement, devolução de Pix, retorno de pagamento, estorno",
        ("OrgnlEndToEndId — original e2e id", "RtrdIntrBkSttlmAmt — returned amount", "RtrRsnInf — return reason"),
        ("pacs.008", "camt.056"),
    ),
    (
        "pacs.007", "pacs", "FI to FI Payment Reversal",
        "Request to reverse/cancel a previously settled payment.",
        "payment reversal, cancel settled payment, reversão de pagamento, cancelamento de liquidação",
        ("OrgnlEndToEndId — original e2e id", "RvslRsnInf — reversal reason"),
        ("pacs.008",),
    ),
    (
        "pacs.009", "pacs", "FI Credit Transfer",
        "Credit transfer between financial institutions for liquidity/settlement (RTGS/STR), not customer Pix.",
        "FI credit transfer, liquidity settlement RTGS STR, transferência entre instituições, liquidação no SPI reservas",
        ("InstgAgt — instructing agent", "InstdAgt — instructed agent", "IntrBkSttlmAmt — settlement amount"),
        ("pacs.002",),
    ),
    (
        "pacs.003", "pacs", "FI to FI Customer Direct Debit",
        "Direct debit collection between financial institutions on behalf of a customer.",
        "direct debit collection, débito direto, cobrança por débito",
        ("InstdAgt — instructed agent", "IntrBkSttlmAmt — settlement amount", "MndtRltdInf — mandate info"),
        ("pacs.002",),
    ),
    (
        "pacs.010", "pacs", "FI Direct Debit",
        "Direct debit between financial institutions (no customer).",
        "FI direct debit, débito direto interbancário",
        ("InstgAgt — instructing agent", "IntrBkSttlmAmt — settlement amount"),
        ("pacs.002",),
    ),
    (
        "camt.056", "camt", "FI to FI Payment Cancellation Request",
        "Request to cancel/return a payment — drives Pix devolução requests.",
        "payment cancellation request, solicitação de cancelamento, pedido de devolução Pix",
        ("OrgnlEndToEndId — original e2e id", "CxlRsnInf — cancellation reason"),
        ("camt.029", "pacs.004"),
    ),
    (
        "camt.029", "camt", "Resolution of Investigation",
        "Response to a cancellation/return request (camt.056): accepted or rejected.",
        "resolution of investigation, cancellation response, resposta a solicitação de cancelamento",
        ("OrgnlEndToEndId — original e2e id", "CxlStsRsnInf — cancellation status reason"),
        ("camt.056",),
    ),
    (
        "camt.052", "camt", "Bank to Customer Account Report",
        "Intraday account report (balances and entries) sent by a bank to its customer — account movement reporting.",
        "account statement notification, account report, intraday balance and entries, extrato de conta intradia, relatório de conta, notificação de movimentação",
        ("Acct — account", "Bal — balance", "Ntry — statement entry", "CdtDbtInd — credit/debit indicator"),
        ("camt.053", "camt.054"),
    ),
    (
        "camt.053", "camt", "Bank to Customer Statement",
        "End-of-day account statement (booked balances and entries) sent by a bank to its customer.",
        "account statement, end of day statement, bank to customer statement, extrato bancário de fim de dia, demonstrativo de conta, statement camt",
        ("Acct — account", "Bal — booked balance", "Ntry — statement entry", "Amt — amount"),
        ("camt.052", "camt.054"),
    ),
    (
        "camt.054", "camt", "Bank to Customer Debit/Credit Notification",
        "Notification of individual debit or credit entries on a customer account — credit/debit advice.",
        "debit credit notification, credit advice, account notification, aviso de crédito e débito, notificação de lançamento, statement notification",
        ("Acct — account", "Ntry — entry", "CdtDbtInd — credit/debit indicator", "Amt — amount"),
        ("camt.052", "camt.053"),
    ),
)


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a temporary one only on a single machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class CommitConflict(RuntimeError):
    """Another writer has committed since this one read the store."""


class Store:
    """The five derived tables below ``folder``, which all executors must see; a missing table is empty.

    A commit is a numbered file that names the files of every table. It is
    written beside its place and renamed to it, which fails if the number is taken, and is never changed
    after; so a reader sees whole commits only, a writer that dies leaves
    the last one as it is, and of two writers from the same state one fails. Tables are
    never written over, so what was read from an older commit stays valid.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self):
        """The folder of commits, its file system, and Hadoop's classes."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        commits = hadoop.Path(f"{self.folder}/commits")
        return commits, commits.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def numbers(self) -> list[int]:
        """Numbers of the commits, ascending."""
        commits, fs, _ = self._files()
        if not fs.exists(commits):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(commits)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def commit(self, number: int) -> dict:
        """What a commit holds: its tables' paths, and the key of the batch that made it."""
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.folder}/commits/{number:020}.json").collect()))

    def latest(self) -> int:
        """The number of the last commit; -1 before the first."""
        return (self.numbers() or [-1])[-1]

    def versions(self, number: int | None = None) -> dict[str, str]:
        number = self.latest() if number is None else number
        return self.commit(number)["tables"] if number >= 0 else {}

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """A table as of a commit, the last one if none is given."""
        path = self.versions(number).get(name)
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{path}") if path else schemas.empty(self.spark, TABLES[name])

    def write(self, tables: dict[str, DataFrame], base: int | None = None, key: str | None = None) -> int:
        """Write the tables as new files, then commit all of them at once on top of ``base``, the commit that they were made from. Returns its number."""
        base = self.latest() if base is None else base
        now = self.versions(base)
        for name, df in tables.items():
            now[name] = f"{name}-{uuid.uuid4().hex}"
            df.select([f.name for f in TABLES[name]]).write.parquet(f"{self.folder}/{now[name]}")
        self._commit(base + 1, {"tables": now, "key": key})
        return base + 1

    def _commit(self, number: int, what: dict) -> None:
        commits, fs, hadoop = self._files()
        part, whole = hadoop.Path(commits, f".{uuid.uuid4().hex}"), hadoop.Path(commits, f"{number:020}.json")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
        out.close()
        context = hadoop.FileContext.getFileContext(fs.makeQualified(part).toUri(), self.spark._jsc.hadoopConfiguration())
        keep_old = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(part), fs.makeQualified(whole), keep_old)
        except Exception as e:
            fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"commit {number} is there already") from e
            raise

    def applied(self, key: str) -> bool:
        """Whether a batch with this key has been committed."""
        commits, fs, _ = self._files()
        return fs.exists(commits) and not self.spark.read.json(f"{self.folder}/commits/*.json", "key string").where(F.col("key") == key).isEmpty()

    def truncate(self) -> None:
        self.write({n: self.spark.createDataFrame([], s) for n, s in TABLES.items()})

    def next_epoch(self, number: int | None = None) -> int:
        return self.read("epoch", number).agg(F.coalesce(F.max("n") + 1, F.lit(0))).first()[0]


def _rows(batch: DataFrame, n: int, clock) -> DataFrame:
    """A gathered batch as concept rows of epoch n."""
    want = {f.name: f.dataType for f in schemas.CONCEPT}
    given = set(batch.columns)
    fill = {"first_epoch": F.lit(n), "last_epoch": F.lit(n), "updated_at": clock, "content_sha": F.sha2(F.coalesce("body", F.lit("")), 256)}
    return batch.select(*[(fill[c] if c in fill else F.col(c) if c in given else F.lit(None)).cast(t).alias(c) for c, t in want.items()])


def _apply(store: Store, batch: DataFrame, links: DataFrame | None, clock, keep_others: bool, dim: int, key: str | None = None, anew: bool = False) -> DataFrame:
    base = store.latest()
    old = {name: schemas.empty(store.spark, schema) if anew else store.read(name, base) for name, schema in TABLES.items()}
    n = 0 if anew else store.next_epoch(base)
    new = schemas.require_unique(_rows(batch, n, clock), "id")
    merged = (upsert_concepts if keep_others else replace_concepts)(old["concept"], new)
    vectors = embed(new, F.concat_ws(" ", "title", "intent_terms", "body"), dim).select("id", F.lit(n).alias("epoch"), F.lit(f"hash-{dim}").alias("embed_model"), "dim", "vec")
    again = F.coalesce(F.col("epoch") == n, F.lit(False))  # old vectors of this epoch, mostly none, go where there is a new one
    others = old["embedding"].where(~again).unionByName(old["embedding"].where(again).join(new.select("id"), "id", "left_anti"))
    embedding = others.unionByName(vectors)
    facts = record_facts(old["fact"], new.select("id", F.lit(n).alias("epoch"), "type", "content_sha", F.col("updated_at").alias("valid_from")), clock)
    epoch = old["epoch"].unionByName(store.spark.range(1).select(F.lit(n).cast("int").alias("n"), clock.alias("created_at"), F.lit("").alias("commit")))
    edge = replace_edges(old["edge"], links) if links is not None else old["edge"]
    number = store.write({"concept": merged, "embedding": embedding, "edge": edge, "fact": facts, "epoch": epoch}, base, key)
    return snapshot_diff(old["concept"], store.read("concept", number))  # both are written and stay


def run_epoch(store: Store, batch: DataFrame, links: DataFrame | None = None, clock=None, dim: int = 64) -> DataFrame:
    """Ingest a full gather as a new epoch; rows that are not in it leave the concept table. Returns (id, change)."""
    return _apply(store, batch, links, F.current_timestamp() if clock is None else clock, False, dim)


def upsert_batch(store: Store, batch: DataFrame, links: DataFrame | None = None, clock=None, dim: int = 64, key: str | None = None) -> DataFrame:
    """Ingest some rows as a new epoch; all others stay. Returns (id, change). A batch whose ``key`` has been committed changes nothing."""
    if key is not None and store.applied(key):
        return store.spark.createDataFrame([], "id string, change string")
    return _apply(store, batch, links, F.current_timestamp() if clock is None else clock, True, dim, key)


def reindex(store: Store, batch: DataFrame, links: DataFrame | None = None, clock=None, dim: int = 64) -> DataFrame:
    """Start the history anew with the gather as epoch 0, in one commit: until then all tables stay as they are. Returns (id, change)."""
    return _apply(store, batch, links, F.current_timestamp() if clock is None else clock, False, dim, anew=True)


def prune_embeddings(store: Store) -> int:
    """Keep each id's latest embedding; returns how many went."""
    base = store.latest()
    old = store.read("embedding", base)
    latest = old.groupBy("id").agg(F.max("epoch").alias("epoch"))
    kept = old.join(latest, ["id", "epoch"], "left_semi")
    gone = old.count() - kept.count()
    if gone:
        store.write({"embedding": kept}, base)
    return gone


def cite(store: Store, found: DataFrame, apply: bool = False) -> dict[str, int]:
    """Add citation edges (src, dst, kind); without ``apply`` only say how many match and how many are new."""
    base = store.latest()
    old = store.read("edge", base)
    new = found.select("src", "dst", "kind").distinct()
    fresh = new.join(old, ["src", "dst", "kind"], "left_anti")
    out = {"matched": new.count(), "new": fresh.count()}
    if apply and out["new"]:
        store.write({"edge": schemas.check_edges(add_edges(old, new))}, base)
    return out


def message_catalogue(spark: SparkSession, messages: Iterable[tuple] = MESSAGES) -> DataFrame:
    """Built-in message definitions as rows in the order of their ids; ValueError for one without id or family."""
    rows = list(messages)
    if any(not m[0] or not m[1] for m in rows):
        raise ValueError("a message needs an id and a family")
    m = spark.createDataFrame(rows, "m string, family string, title string, summary string, intent string, fields array<string>, links array<string>")
    kind = F.when(F.col("family") == "pacs", "PacsMessage").when(F.col("family") == "camt", "CamtMessage").otherwise("IsoMessage")
    part = lambda c, head, one: F.when(F.size(c) > 0, F.concat(F.lit(head), F.array_join(F.transform(c, one), ""), F.lit("\n"))).otherwise("")
    row = lambda f: F.concat(F.lit("| `"), F.substring_index(f, " — ", 1), F.lit("` | "), F.when(F.contains(f, F.lit(" — ")), F.regexp_replace(f, "^.*? — ", "")).otherwise(""), F.lit(" |\n"))
    terms = F.when(F.col("intent") != "", F.concat(F.lit("Termos / Terms: "), "intent", F.lit("\n\n"))).otherwise("")
    fields = part("fields", "## Key fields\n\n| Field | Description |\n|-------|-------------|\n", row)
    links = part("links", "## Related messages\n\n", lambda x: F.concat(F.lit("- ["), x, F.lit("](messages/"), x, F.lit(".md)\n")))
    body = F.concat(F.lit("# "), "m", F.lit(" — "), "title", F.lit("\n\n"), "summary", F.lit("\n\n"), terms, fields, links)
    tags = F.array(F.lit("iso20022"), F.col("family"), F.replace("m", F.lit("."), F.lit("")))
    return m.select(F.concat(F.lit("messages/"), "m", F.lit(".md")).alias("id"), kind.alias("type"), "title", body.alias("body"), F.col("intent").alias("intent_terms"), F.lit("en").alias("language"), tags.alias("tags"), F.concat(F.lit("iso20022:"), "m").alias("source_uri")).orderBy("id")


def export_bundle(folder: str, archive: str) -> int:
    """Pack a local bundle folder, without .git, as tar.gz; returns the number of files. Not a query: it runs where it is called."""
    files = [p for p in sorted(Path(folder).rglob("*")) if p.is_file() and ".git" not in p.relative_to(folder).parts]
    with tarfile.open(archive, "w:gz") as out:
        for p in files:
            out.add(p, p.relative_to(folder))
    return len(files)


def append_log(folder: str, line: str) -> None:
    """Append one line to a bundle's log; the folder is a path, or a URI of a file system that can append."""
    files, base = file_system(folder)
    with files.open_append_stream(f"{base}/log.md") as f:
        f.write(f"- {line}\n".encode())


def manifest_json(store: Store) -> str:
    return json.dumps(store.versions(), sort_keys=True)


# -- queries ---------------------------------------------------------------
def _store_of(spark, d) -> tuple[Store, DataFrame]:
    """A new store with a first epoch of all concepts but those of one last epoch, and all concepts."""
    store, rows = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"), concepts(spark, d)
    run_epoch(store, rows.where("last_epoch <> 3"), clock=F.lit("2024-01-01").cast("timestamp"))
    return store, rows


@query("T10_ingest_run", f"WITH {CONCEPT_SQL} SELECT id, CASE last_epoch WHEN 3 THEN 'added' WHEN 4 THEN 'removed' ELSE 'changed' END AS change FROM concept WHERE last_epoch IN (3, 4) OR first_epoch = 1")
def t10(spark, d):
    store, rows = _store_of(spark, d)
    later = rows.where("last_epoch <> 4").withColumn("body", F.when(F.col("first_epoch") == 1, F.concat("body", F.lit(" new"))).otherwise(F.col("body")))
    return run_epoch(store, later, clock=F.lit("2024-02-01").cast("timestamp")).select("id", "change")


@query("T11_batch_upsert", f"WITH {CONCEPT_SQL} SELECT id, (last_epoch = 3)::INT AS first_epoch, (last_epoch IN (3, 4))::INT AS last_epoch FROM concept")
def t11(spark, d):
    """The same batch twice: its key lets it in once."""
    store, rows = _store_of(spark, d)
    for _ in range(2):
        upsert_batch(store, rows.where("last_epoch in (3, 4)"), clock=F.lit("2024-02-01").cast("timestamp"), key="b")
    return store.read("concept").select("id", "first_epoch", "last_epoch")


@query("T12_reindex", f"WITH {CONCEPT_SQL} SELECT id, 0 AS epoch, true AS open FROM concept WHERE last_epoch <> 4")
def t12(spark, d):
    store, rows = _store_of(spark, d)
    reindex(store, rows.where("last_epoch <> 4"), clock=F.lit("2024-02-01").cast("timestamp"))
    return store.read("fact").select("id", "epoch", F.col("tx_to").isNull().alias("open"))


QUERIES, SQL = registry.queries, registry.sql
