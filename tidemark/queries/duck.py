"""DuckDB SQL fragments shared by the oracles (independent formulations of
the Spark operators, written in DuckDB's dialect)."""


def packed(col: str) -> str:
    return f"list_filter(string_split(coalesce({col}, ''), ';'), lambda v: v <> '')"


def u64_item(v: str) -> str:
    return (f"CASE WHEN regexp_full_match({v}, '[+]?[0-9]+') "
            f"AND TRY_CAST(ltrim({v}, '+') AS HUGEINT) <= 18446744073709551615 "
            f"THEN TRY_CAST(ltrim({v}, '+') AS HUGEINT) END")


def sizes(col: str, aligned: bool = False) -> str:
    t = f"list_transform(string_split(coalesce({col}, ''), ';'), lambda v: {u64_item('v')})"
    return t if aligned else f"list_filter({t}, lambda v: v IS NOT NULL)"


def basename(col: str) -> str:
    return f"regexp_extract({col}, '[^/]*$')"


def processed_cte(src: str = "run_report") -> str:
    """Processed runs (X3) in DuckDB."""
    return f"""processed AS (
  SELECT run_accession, u[1] AS fastq_ftp_1_url,
    CASE WHEN len(u) >= 2 AND len(m) >= 2 THEN u[2] END AS fastq_ftp_2_url,
    {basename('u[1]')} AS fastq_ftp_1_name,
    CASE WHEN len(u) >= 2 AND len(m) >= 2 THEN {basename('u[2]')} END AS fastq_ftp_2_name,
    m[1] AS fastq_md5_1,
    CASE WHEN len(u) >= 2 AND len(m) >= 2 THEN m[2] END AS fastq_md5_2,
    coalesce(z[1], 0) AS fastq_bytes_1,
    CASE WHEN len(u) >= 2 AND len(m) >= 2 THEN z[2] END AS fastq_bytes_2,
    sample_title
  FROM (SELECT run_accession, coalesce(sample_title, '') AS sample_title,
          {packed('fastq_ftp')} AS u, {packed('fastq_md5')} AS m, {sizes('fastq_bytes')} AS z
        FROM {src}) s
  WHERE len(u) > 0 AND len(m) > 0)"""
