"""Errors that callers can tell apart."""


class InputError(Exception):
    """A file can't be used; ``path`` says which."""

    def __init__(self, path: str, why: str):
        super().__init__(f"{path}: {why}")
        self.path = path


class FileMissing(InputError):
    def __init__(self, path: str):
        super().__init__(path, "not found")


class MatrixError(InputError):
    """A matrix file has no count line, another size, or lacks a gene."""


class UnknownGene(Exception):
    """Genes of a family that the gene book doesn't have."""


class UnknownSpecies(Exception):
    """Species of genes that the species tree doesn't have."""


class IncompleteTree(Exception):
    """A gene tree that lacks genes of its family or has some twice."""
