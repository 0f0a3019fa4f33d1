"""Small inline inputs."""

from pyspark.sql import functions as F


def motif_rows(spark, motif_id, matrix):
    return spark.createDataFrame(
        [(motif_id, i, *map(float, r)) for i, r in enumerate(matrix)], "motif_id long, pos int, a double, c double, g double, t double")


def consensus_matrix(text):
    return [[0.97 if b == x else 0.01 for x in "ACGT"] for b in text]


def text_chain(spark, sequences, motif_id=1, sample_id=1):
    rows, offset = [], 0
    for i, s in enumerate(sequences):
        rows.append((sample_id, i, f"C{i}", s, offset, motif_id))
        offset += len(s)
    return spark.createDataFrame(rows, "sample_id long, chain_ord int, chain string, sequence string, offset int, motif_id long")


ATOM_DDL = ("structure_id string, atom_ord long, record string, name string, resname string, chain string, resseq int, "
            "icode string, x double, y double, z double, element string")


def toy_complex(spark, sequence, contacted, drop=()):
    """One ARG at the origin; DNA with N1 and P, one base at the origin and the
    rest at least 100 away.  ``drop``: (position, atom name) pairs left out."""
    rows = [("s", 0, "ATOM", "CZ", "ARG", "A", 1, "", 0.0, 0.0, 0.0, "C")]
    for i, b in enumerate(sequence):
        x = 0.0 if i == contacted else 100.0 + i
        for name, xyz in (("N1", (x, 0.0, 0.0)), ("P", (100.0 + i, 5.0, 0.0))):
            if (i, name) not in drop:
                rows.append(("s", len(rows), "ATOM", name, "D" + b, "B", i + 1, "", *xyz, name[0]))
    return spark.createDataFrame(rows, ATOM_DDL)


def pwm_pair(spark, target, pred, sample="s"):
    rows = [(sample, i, *map(float, t), *map(float, p)) for i, (t, p) in enumerate(zip(target, pred))]
    return spark.createDataFrame(
        rows, "sample_id string, pos int, a double, c double, g double, t double, p_a double, p_c double, p_g double, p_t double")


def binary(spark, labels, scores, group="g"):
    return spark.createDataFrame([(group, i, int(y), float(s)) for i, (y, s) in enumerate(zip(labels, scores))],
                                 "grp string, row_id long, y_true int, score double")


def first(df):
    return df.collect()[0]


def col_sum(df, name):
    return df.agg(F.sum(name)).collect()[0][0]
