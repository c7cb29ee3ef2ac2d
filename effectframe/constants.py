"""Names, word lists, patterns and texts the results depend on."""

# --- variant summary table -------------------------------------------------
VARIANT_COLUMNS = [
    "VariationID",
    "Name",
    "GeneSymbol",
    "ClinicalSignificance",
    "ReviewStatus",
    "Assembly",
    "Chromosome",
    "ChromosomeAccession",
    "PositionVCF",
    "ReferenceAlleleVCF",
    "AlternateAlleleVCF",
    "Start",
    "Stop",
    "ReferenceAllele",
    "AlternateAllele",
    "PhenotypeIDS",
    "PhenotypeList",
]
ASSEMBLY = "GRCh38"
REVIEW_STATUS = "criteria provided, multiple submitters, no conflicts"
PATHOGENIC_TERMS = ["pathogenic", "likely pathogenic", "pathogenic/likely pathogenic"]
BENIGN_TERMS = ["benign", "likely benign", "benign/likely benign"]
GENE_SYMBOL_PATTERN = r"^[A-Za-z0-9\-]{2,15}$"
GENE_IN_NAME_PATTERN = r"\(([A-Za-z0-9\-]+)\)\s*:"
GENE_SEPARATOR_PATTERN = r"[;,\s|/]+"
NON_GENE_WORDS = ["covers", "genes", "region", "none of which", "dosage"]

# Texts which a delimited file stands for a missing value (pandas defaults).
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- consequence annotation ------------------------------------------------
ANNOTATION_COLUMNS = [
    "VariationID",
    "hgvsc",
    "hgvsp",
    "most_severe_consequence",
    "impact",
    "consequence_terms",
    "gene_symbol",
    "gene_symbol_source",
    "gene_id",
    "hgnc_id",
    "transcript_id",
    "mane_select",
    "mane_plus_clinical",
    "canonical",
    "strand",
    "variant_allele",
    "protein_id",
    "protein_start",
    "protein_end",
    "amino_acids",
    "codons",
    "cdna_start",
    "cdna_end",
    "cds_start",
    "cds_end",
    "assembly_name",
    "allele_string",
    "swissprot",
    "uniprot_isoform",
    "uniparc",
]
ANNOTATION_LONG_COLUMNS = [
    "protein_start",
    "protein_end",
    "cdna_start",
    "cdna_end",
    "cds_start",
    "cds_end",
]
TRANSCRIPT_FIELDS = [
    "gene_symbol",
    "gene_symbol_source",
    "gene_id",
    "hgnc_id",
    "transcript_id",
    "mane_select",
    "mane_plus_clinical",
    "canonical",
    "strand",
    "variant_allele",
    "impact",
    "consequence_terms",
    "hgvsc",
    "hgvsp",
    "amino_acids",
    "codons",
    "protein_id",
    "protein_start",
    "protein_end",
    "protein_id_source",
    "protein_length",
    "protein_id_version",
    "swissprot",
    "uniprot_isoform",
    "uniparc",
    "cdna_start",
    "cdna_end",
    "cds_start",
    "cds_end",
]
PROTEIN_ID_PATTERN = r"^(ENSP\d+)"
PROTEIN_CHANGE_PATTERN = r"(p\.[^ \t|]+)"
VCF_INPUT_COLUMNS = [
    "VariationID",
    "ChromosomeAccession",
    "PositionVCF",
    "ReferenceAlleleVCF",
    "AlternateAlleleVCF",
]
ANNOTATOR_INPUT_COLUMNS = VCF_INPUT_COLUMNS + ["GeneSymbol", "hgvsc", "hgvsp", "ClinicalSignificance"]
VCF_HEADER = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"]
PROTEIN_PAIR_COLUMNS = ["id", "protein_id", "hgvsp", "consequence_terms", "seq_wt", "seq_mt"]

# --- sequences and vectors -------------------------------------------------
DNA_LETTERS = "ACGTN"
AMINO_ACID_LETTERS = "ACDEFGHIKLMNPQRSTVWY"
NORM_EPSILON = 1e-8
NOISE_STD_EPSILON = 1e-6

# --- ontology graph --------------------------------------------------------
TERM_ID_PATTERN = r"(GO[:_]\d{7})"
ROOT_TERMS = ["GO:0008150", "GO:0003674", "GO:0005575"]
CURATED_EVIDENCE = ["EXP", "IDA", "IPI", "IMP", "IGI", "IEP", "TAS", "IC"]
HUMAN_TAXON = "9606"
GENE_PREFIX = "G::"
TERM_PREFIX = "T::"

# --- prompts and scores ----------------------------------------------------
LABEL_WORDS = ["Benign", "Pathogenic"]
PROMPT_HEAD = "Variant context:\n"
PROMPT_TAIL = "\n\nPredict label:"
CHAT_SYSTEM = """You are an assistant trained for clinical genetics.
Given minimal variant context, your task is to predict the variant’s
clinical significance as a binary label.

Output **only** one word: either "Benign" or "Pathogenic".
"""
PROMPT_SOURCE_COLUMNS = [
    "gene_symbol",
    "GeneSymbol",
    "mane_select",
    "transcript_id",
    "protein_id",
    "hgvsc",
    "hgvsp",
    "most_severe_consequence",
    "impact",
    "consequence_terms",
    "variant_allele",
    "amino_acids",
    "codons",
]
PROMPT_FIELD_MODES = {
    "prompt_no_hgvsp": ["hgvsp", "hgvs.p", "hgvs_p"],
    "prompt_no_hgvsc": ["hgvsc", "hgvs.c", "hgvs_c"],
    "prompt_no_gene": ["gene_symbol", "genesymbol"],
}
PROMPT_HGVS_P_PATTERN = r"(?i)\bp\.(?!\[)[A-Za-z0-9_=*]+"
PROMPT_HGVS_C_PATTERN = r"(?i)\bc\.(?!\[)[A-Za-z0-9_+\-*>=<]+"
PROMPT_LABEL_PATTERN = r"(?i)\b(benign|pathogenic)\b"
REAL_HGVS_P_PATTERN = r"(?i)p\.(?!\[)[^\s,;:/\]]+"
REAL_HGVS_C_PATTERN = r"(?i)c\.(?!\[)[^\s,;:/\]]+"
THINK_BLOCK_PATTERN = r"(?is)<think>.*?</think>"
THINK_TAG_PATTERN = r"(?is)</?think>"
WORST_LOG_SCORE = -1e9
