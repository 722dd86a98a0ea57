"""Count models of cases over exposure: Poisson, NB2 and their zero-inflated forms, with and without covariates."""
