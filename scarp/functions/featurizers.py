"""Structure strings to vectors: a registry of pluggable featurizers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: name -> builder(structure column, options): a column array<double>.
FEATURIZERS: dict[str, Callable[..., Column]] = {}
FINGERPRINTS = ("morgan", "maccs", "rdkit", "atom_pair", "topological_torsion")


def register_featurizer(name: str):
    def add(builder):
        FEATURIZERS[name] = builder
        return builder

    return add


@register_featurizer("hashed_ngrams")
def hashed_ngrams(structure: Column, n_bits: int = 1024, size: int = 3, **_) -> Column:
    """Bits of hashed character n-grams: needs no chemistry library and stays in the JVM."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(structure) - size + 1, F.lit(1)))
    on = F.array_distinct(F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(structure, i, F.lit(size))), F.lit(n_bits)).cast("int")))
    return F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda i: F.array_contains(on, i).cast("double"))


def _chemistry(kind: str):
    """A fingerprint by an installed chemistry library, loaded on the executors only."""

    def builder(structure: Column, n_bits: int = 1024, radius: int = 2, chirality: bool = False, **_) -> Column:
        import pandas as pd

        @F.pandas_udf("array<double>")
        def fingerprint(values: pd.Series) -> pd.Series:
            from rdkit import Chem
            from rdkit.Chem import MACCSkeys, rdFingerprintGenerator as generators

            made = {
                "morgan": lambda: generators.GetMorganGenerator(radius=radius, fpSize=n_bits, includeChirality=chirality),
                "rdkit": lambda: generators.GetRDKitFPGenerator(fpSize=n_bits),
                "atom_pair": lambda: generators.GetAtomPairGenerator(fpSize=n_bits),
                "topological_torsion": lambda: generators.GetTopologicalTorsionGenerator(fpSize=n_bits),
            }
            of = MACCSkeys.GenMACCSKeys if kind == "maccs" else made[kind]().GetFingerprint
            mols = (Chem.MolFromSmiles(v) if v else None for v in values)
            return pd.Series([None if m is None else [float(x) for x in of(m)] for m in mols])

        return fingerprint(structure)

    return builder


for _kind in FINGERPRINTS:
    FEATURIZERS[_kind] = _chemistry(_kind)


#: Vectors that a row may lack: a structure that such a method cannot read keeps its row.
OPTIONAL = {"chemeleon"}


def register_encoder(name: str, load: Callable[[], Callable[[list[str]], list]]) -> None:
    """A featurizer from a model: `load` runs once in each Python worker and gives a function of a list of structures.

    The function gives a vector for each structure, or None where it cannot.
    """

    def builder(structure: Column, batch: int = 64, **_) -> Column:
        import pandas as pd

        def encode(parts):
            of = load()
            for values in parts:
                out: list = []
                for i in range(0, len(values), batch):
                    out += [None if v is None else [float(x) for x in v] for v in of([s or "" for s in values.iloc[i : i + batch]])]
                yield pd.Series(out)

        encode.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(encode, "array<double>")(structure)

    FEATURIZERS[name] = builder


def _transformer(model: str, pooled: bool):
    """A language model of structures, by an installed library: its pooled output or the mean of its last layer."""

    def load():
        import torch
        from transformers import AutoModel, AutoTokenizer

        tokenizer, net = AutoTokenizer.from_pretrained(model, trust_remote_code=True), AutoModel.from_pretrained(model, trust_remote_code=True).eval()

        def of(structures: list[str]):
            with torch.no_grad():
                inputs = tokenizer(structures, padding=True, return_tensors="pt")
                found = net(**inputs)
            if pooled:
                return found.pooler_output.tolist()
            mask = inputs["attention_mask"].unsqueeze(-1)
            return ((found.last_hidden_state * mask).sum(1) / mask.sum(1)).tolist()

        return of

    return load


def _message_passing(weights: str):
    """A message-passing network of molecular graphs, by an installed library and a file of weights; None for what it cannot read."""

    def load():
        import torch
        from chemprop import nn
        from chemprop.data import BatchMolGraph
        from chemprop.featurizers import SimpleMoleculeMolGraphFeaturizer
        from rdkit import Chem

        stored = torch.load(weights, weights_only=True)
        message, pool, graph = nn.BondMessagePassing(**stored["hyper_parameters"]), nn.MeanAggregation(), SimpleMoleculeMolGraphFeaturizer()
        message.load_state_dict(stored["state_dict"])
        message.eval()

        def of(structures: list[str]):
            mols = [Chem.MolFromSmiles(s) for s in structures]
            held = BatchMolGraph([graph(m) for m in mols if m is not None])
            with torch.no_grad():
                vectors = iter(pool(message(held), held.batch).tolist())
            return [None if m is None else next(vectors) for m in mols]

        return of

    return load


#: Fixed names: models of the same names as their methods.
register_encoder("molformer", _transformer("ibm/MoLFormer-XL-both-10pct", pooled=True))
register_encoder("chemberta", _transformer("DeepChem/ChemBERTa-77M-MTR", pooled=False))
register_encoder("chemeleon", _message_passing("data/chemeleon_mp.pt"))


def featurize(compounds: DataFrame, methods: list[str], **options) -> DataFrame:
    """compounds (pos, structure) with one vector column per method; rows that a method cannot read are left out, unless it is OPTIONAL."""
    from scarp.operators import structures

    for m in methods:
        if m not in FEATURIZERS and m not in structures.FINGERPRINTS:
            raise ValueError(f"unknown featurizer {m!r}; known: {', '.join(sorted([*FEATURIZERS, *structures.FINGERPRINTS]))}")
    # only circular fingerprints take the options; the others keep their own sizes
    columns = {m: FEATURIZERS[m](F.col("structure"), **(options if m in ("morgan", "hashed_ngrams") else {})) for m in methods if m in FEATURIZERS}
    needed = [m for m in methods if m not in OPTIONAL]
    found = compounds.withColumns(columns)
    joined = [m for m in methods if m not in FEATURIZERS]
    if joined:
        read = structures.Structures(compounds, bool(options.get("chirality")))
        for m in joined:
            kind = {k: v for k, v in options.items() if k == "radius" and m == "circular"}
            own = structures.bits(structures.FINGERPRINTS[m](read, **kind), read.read, options.get("n_bits") or 1024)
            found = found.join(own.withColumnRenamed("embedding", m), "pos", "left")
    return found.dropna(subset=needed) if needed else found


def check_reuse(columns: list[str], stored: dict | None, method: str, wanted: dict) -> bool:
    """Whether a stored vector column may be used: it is there and, for circular fingerprints, made with the same options.

    Without a record of the options (None) the column is trusted.
    """
    if method not in columns:
        return False
    differing = {k: v for k, v in wanted.items() if v is not None and stored is not None and stored.get(k) != v}
    if method == "morgan" and differing:
        raise ValueError(f"stored {method} vectors were made with other options: {differing}")
    return True
