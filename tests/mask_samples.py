"""Where the small tables are, and sample rows for the masking tests."""

SF001 = "/root/testdata/sf0.001"


def samples(spark, rows):
    """rows: list of (doc_id, text, [(span, type), ...])."""
    from cloakline.schemas import SAMPLES
    return spark.createDataFrame(
        [(d, d, "t", t, [{"span": s, "phi_type": ty} for s, ty in spans]) for d, t, spans in rows], SAMPLES)
