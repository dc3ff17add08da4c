"""FLAG bits of alignment records."""

# The SAM specification's FLAG bits.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE = 1, 4, 8, 16
FIRST, LAST, SECONDARY, DUPLICATE, SUPPLEMENTARY = 64, 128, 256, 1024, 2048
NOT_PRIMARY = SECONDARY | SUPPLEMENTARY


def has(flag, bit):
    """Column condition: any of the bits is set."""
    return flag.bitwiseAND(bit) != 0
