"""Column functions: circular statistics, uncertainty, links, Gaussian-process coefficients."""
