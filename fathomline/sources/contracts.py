"""What well-known C library functions do with memory that their callers pass.

Fixed values: name, fixed parameters, variadic, result, arguments read, arguments
written, copied argument pair (destination<source), policy.  The last name stands for
all that begin with it.  A result is fresh
memory, an alias of an argument, either, an object outside the program, a retained
state, a scalar or nothing.  Only exact names with the exact shape count; all other
external calls are boundaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Contracts of library functions.
CONTRACTS = [
    ("malloc", 1, False, "fresh", [], [], None, "plain"),
    ("calloc", 2, False, "fresh", [], [], None, "plain"),
    ("aligned_alloc", 2, False, "fresh", [], [], None, "plain"),
    ("realloc", 2, False, "alias0_or_fresh", [], [], None, "plain"),
    ("free", 1, False, "void", [], [], None, "plain"),
    ("strdup", 1, False, "fresh", [0], [], None, "plain"),
    ("strchr", 2, False, "alias0", [0], [], None, "plain"),
    ("strrchr", 2, False, "alias0", [0], [], None, "plain"),
    ("memchr", 2, False, "alias0", [0], [], None, "plain"),
    ("strstr", 2, False, "alias0", [0, 1], [], None, "plain"),
    ("strpbrk", 2, False, "alias0", [0, 1], [], None, "plain"),
    ("strlen", 1, False, "scalar", [0], [], None, "plain"),
    ("atoi", 1, False, "scalar", [0], [], None, "plain"),
    ("atol", 1, False, "scalar", [0], [], None, "plain"),
    ("atoll", 1, False, "scalar", [0], [], None, "plain"),
    ("strcmp", 2, False, "scalar", [0, 1], [], None, "plain"),
    ("strcasecmp", 2, False, "scalar", [0, 1], [], None, "plain"),
    ("strcoll", 2, False, "scalar", [0, 1], [], None, "plain"),
    ("strverscmp", 2, False, "scalar", [0, 1], [], None, "plain"),
    ("strncmp", 3, False, "scalar", [0, 1], [], None, "plain"),
    ("memcmp", 3, False, "scalar", [0, 1], [], None, "plain"),
    ("strcpy", 2, False, "alias0", [1], [0], None, "plain"),
    ("strcat", 2, False, "alias0", [0, 1], [0], None, "plain"),
    ("strncpy", 3, False, "alias0", [1], [0], None, "plain"),
    ("memcpy", 3, False, "alias0", [], [], "0<1", "plain"),
    ("memmove", 3, False, "alias0", [], [], "0<1", "plain"),
    ("memset", 3, False, "alias0", [], [0], None, "plain"),
    ("mbstowcs", 3, False, "scalar", [1], [0], None, "plain"),
    ("strtok", 2, False, "retained", [0, 1], [0], None, "retains0"),
    ("strtoul", 3, False, "scalar", [0], [], None, "stores0to1"),
    ("__errno_location", 0, False, "external", [], [], None, "plain"),
    ("__ctype_b_loc", 0, False, "ctype", [], [], None, "plain"),
    ("getenv", 1, False, "external", [0], [], None, "plain"),
    ("getgrgid", 1, False, "external", [], [], None, "plain"),
    ("getpwuid", 1, False, "external", [], [], None, "plain"),
    ("localtime", 1, False, "external", [0], [], None, "plain"),
    ("nl_langinfo", 1, False, "external", [], [], None, "plain"),
    ("setlocale", 2, False, "external", [1], [], None, "plain"),
    ("fopen", 2, False, "external", [0, 1], [], None, "plain"),
    ("fopen64", 2, False, "external", [0, 1], [], None, "plain"),
    ("fdopen", 2, False, "external", [1], [], None, "plain"),
    ("opendir", 1, False, "external", [0], [], None, "plain"),
    ("readdir", 1, False, "external", [], [], None, "plain"),
    ("readdir64", 1, False, "external", [], [], None, "plain"),
    ("closedir", 1, False, "scalar", [], [], None, "plain"),
    ("fclose", 1, False, "scalar", [], [], None, "plain"),
    ("fgets", 3, False, "alias0", [], [0], None, "plain"),
    ("fread", 4, False, "scalar", [], [0], None, "plain"),
    ("fwrite", 4, False, "scalar", [0], [], None, "plain"),
    ("fputs", 2, False, "scalar", [0], [], None, "plain"),
    ("fputc", 2, False, "scalar", [], [], None, "plain"),
    ("putc", 2, False, "scalar", [], [], None, "plain"),
    ("gethostname", 2, False, "scalar", [], [0], None, "plain"),
    ("getxattr", 4, False, "scalar", [0, 1], [2], None, "plain"),
    ("listxattr", 3, False, "scalar", [0], [1], None, "plain"),
    ("readlink", 3, False, "scalar", [0], [1], None, "plain"),
    ("realpath", 2, False, "alias1_or_fresh", [0], [1], None, "plain"),
    ("stat", 2, False, "scalar", [0], [1], None, "plain"),
    ("stat64", 2, False, "scalar", [0], [1], None, "plain"),
    ("lstat", 2, False, "scalar", [0], [1], None, "plain"),
    ("lstat64", 2, False, "scalar", [0], [1], None, "plain"),
    ("__xstat", 3, False, "scalar", [1], [2], None, "plain"),
    ("__xstat64", 3, False, "scalar", [1], [2], None, "plain"),
    ("__lxstat", 3, False, "scalar", [1], [2], None, "plain"),
    ("__lxstat64", 3, False, "scalar", [1], [2], None, "plain"),
    ("__fxstat", 3, False, "scalar", [], [2], None, "plain"),
    ("__fxstat64", 3, False, "scalar", [], [2], None, "plain"),
    ("strftime", 4, False, "scalar", [1, 2, 3], [0], None, "plain"),
    ("time", 1, False, "scalar", [], [0], None, "plain"),
    ("access", 2, False, "scalar", [0], [], None, "plain"),
    ("isatty", 1, False, "scalar", [], [], None, "plain"),
    ("iswprint", 1, False, "scalar", [], [], None, "plain"),
    ("tolower", 1, False, "scalar", [], [], None, "plain"),
    ("exit", 1, False, "void", [], [], None, "plain"),
    ("open", 2, True, "scalar", [0], [], None, "plain"),
    ("fcntl", 2, True, "scalar", [], [], None, "no_variadic"),
    ("printf", 1, True, "scalar", [0], [], None, "printf"),
    ("fprintf", 2, True, "scalar", [1], [], None, "printf"),
    ("dprintf", 2, True, "scalar", [1], [], None, "printf"),
    ("sprintf", 2, True, "scalar", [1], [0], None, "printf"),
    ("snprintf", 3, True, "scalar", [1, 2], [0], None, "printf"),
    ("scanf", 1, True, "scalar", [0], [], None, "scanf"),
    ("wscanf", 1, True, "scalar", [0], [], None, "scanf"),
    ("fscanf", 2, True, "scalar", [1], [], None, "scanf"),
    ("fwscanf", 2, True, "scalar", [1], [], None, "scanf"),
    ("sscanf", 2, True, "scalar", [0, 1], [], None, "scanf"),
    ("swscanf", 2, True, "scalar", [0, 1], [], None, "scanf"),
    ("__ctype_get_", 0, False, "scalar", [], [], None, "plain"),
]
#: Prefixes that scanf's functions also go by.
SCANF_PREFIXES = ("__isoc99_", "__isoc23_")

SCHEMA = "name string, fixed_params int, vararg boolean, result string, reads array<int>, writes array<int>, copies string, policy string"


def contracts(spark: SparkSession) -> DataFrame:
    """The table above, a row each: small and of fixed size, so joins with it broadcast."""
    rows = list(CONTRACTS)
    rows += [(p + name, *row) for name, *row in CONTRACTS if row[-1] == "scanf" for p in SCANF_PREFIXES]
    return spark.createDataFrame(rows, SCHEMA)
