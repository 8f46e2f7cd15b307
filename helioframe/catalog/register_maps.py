"""Register maps of the supported devices, stated as plain data.

Nothing in this module computes: it lists what each device calls its words.
`helioframe.catalog` turns the text into typed rules.
"""

# Driver key used in a registry, label, version, tries per block.
DRIVERS = """
dcb_kernel_st0hs2425         KERNEL_DCB_ST0HS2425                0.1   3
dcb_kernel_st0hs2425_single  KERNEL_DCB_ST0HS2425                0.1   3
ekk_schneider_ion_7650       SCHNEIDER_ION_7650_TCP_INAVITAS     0.1  10
ekk_socomec_dirisa10         SOCOMEC_DIRIS_A10                   0.1   3
inv_abb_pvs800               ABB_PVS800_TCP                      0.2   3
inv_abb_pvs980               ABB_PVS980_TCP                      0.1  10
sensor_irradiation_akfen     SENSORS_INAVITAS_IRRADIATION        0.1   3
sensor_kippzonen_smp11       SENSORS_PYRANOMETER_KIPPZONEN_SMP11 0.1   3
sensor_lufft_ws600           SENSORS_LUFFT_WS600                 0.1   3
sensor_sevensolar_3SISTMB    SENSORS_IRRADIATION_VANARISU        0.1   3
"""

# Driver, block number, register kind, first register, word count.
BLOCKS = """
dcb_kernel_st0hs2425         1  input       51   47
dcb_kernel_st0hs2425_single  1  input       51    2
ekk_schneider_ion_7650       1  holding    149  116
ekk_schneider_ion_7650       2  holding     20    6
ekk_socomec_dirisa10         1  holding  50514   30
ekk_socomec_dirisa10         2  holding  50780   10
ekk_socomec_dirisa10         3  holding  51536    9
inv_abb_pvs800               1  holding  42496    7
inv_abb_pvs800               2  holding  42545   27
inv_abb_pvs800               3  holding  42599    8
inv_abb_pvs980               0  holding  42240   12
inv_abb_pvs980               1  holding  42496    7
inv_abb_pvs980               2  holding  42545   33
inv_abb_pvs980               3  holding  42599   13
sensor_irradiation_akfen     1  holding      6    1
sensor_kippzonen_smp11       1  input        5    1
sensor_lufft_ws600           1  input        0   50
sensor_sevensolar_3SISTMB    1  input        0    9
"""

# A read of this block also has to carry a phase A voltage other than zero
# (32 bits in words 16 and 17) before it counts as a good attempt.
ACCEPT = {
    ("ekk_schneider_ion_7650", 1): (
        "get(registers, 16) BETWEEN 0 AND 65535 AND get(registers, 17) BETWEEN 0 AND 65535 "
        "AND (get(registers, 16) <> 0 OR get(registers, 17) <> 0)"
    ),
}

# Field, kind, block, word, scale. A 32-bit kind names its high
# word, then its low word. "clamp" turns values below zero into zero.
FIELDS = {
    "dcb_kernel_st0hs2425": "\n".join(f"I_DC_{n} u16 1 {n - 1} /1000" for n in range(1, 25)) + """
V_DC           u16  1  32     /1
Cabinet_Temp   u16  1  37     /1
Board_Temp     u16  1  38     /1
Total_Current  u16  1  39     /10
Power          u32  1  41,40  /1
""",
    "dcb_kernel_st0hs2425_single": """
I_DC_25  u16  1  0  /1000
""",
    "ekk_schneider_ion_7650": """
Ia          u16  1  0      /10
Ib          u16  1  1      /10
Ic          u16  1  2      /10
Freq        u16  1  9      /10
Vll_ab      u32  1  28,29  /1
Vll_ac      u32  1  30,31  /1
Vll_ca      u32  1  32,33  /1
kW_tot      s32  1  54,55  /1
kVAR_tot    s32  1  64,65  /1
kVA_tot     s32  1  74,75  /1
kWh_del     s32  1  80,81  /1
kWh_rec     s32  1  82,83  /1
kVARh_del   s32  1  84,85  /1
kVARh_rec   s32  1  86,87  /1
I1_THD_max  s16  2  0      /100
I2_THD_max  s16  2  1      /100
I3_THD_max  s16  2  2      /100
V1_THD_max  s16  2  3      /100
V2_THD_max  s16  2  4      /100
V3_THD_max  s16  2  5      /100
PF_tot      s16  1  115    /100
""",
    "ekk_socomec_dirisa10": """
U12                       u32  1  0,1    /100
U23                       u32  1  2,3    /100
U31                       u32  1  4,5    /100
V1                        u32  1  6,7    /100
V2                        u32  1  8,9    /100
V3                        u32  1  10,11  /100
F                         u32  1  12,13  /100
I1                        u32  1  14,15  /1000
I2                        u32  1  16,17  /1000
I3                        u32  1  18,19  /1000
In                        u32  1  20,21  /1000
P                         s32  1  22,23  /1  *10
Q                         s32  1  24,25  /1  *10
S                         u32  1  26,27  /1  *10
Pf                        s32  1  28,29  /1000
Active_Energy_Positive    u32  2  0,1    /1
Reactive_Energy_Positive  u32  2  2,3    /1
Apparent_Energy           s32  2  4,5    /1
Active_Energy_Negative    s32  2  6,7    /1
Reactive_Energy_Negative  s32  2  8,9    /1
THD_U12                   u16  3  0      /10
THD_U23                   u16  3  1      /10
THD_U31                   u16  3  2      /10
THD_V1                    u16  3  3      /10
THD_V2                    u16  3  4      /10
THD_V3                    u16  3  5      /10
THD_I1                    u16  3  6      /10
THD_I2                    u16  3  7      /10
THD_I3                    u16  3  8      /10
""",
    "inv_abb_pvs800": """
Active_Power            s16  1  2      /1
Reactive_Power          s16  1  3      /1
Grid_Voltage            u16  1  4      /10
Grid_Frequency          u16  1  5      /100
PowerFactor             s16  1  6      /1000
L1_Voltage              u16  2  1      /10
L2_Voltage              u16  2  2      /10
L3_Voltage              u16  2  3      /10
Grid_Current            u16  2  4      /10
DC_Input_Voltage        u16  2  5      /10
DC_Bus_Voltage          u16  2  6      /10
DC_Input_Current        u16  2  7      /10
Grounding_Current       u16  2  8      /1
Isolation_Resistance    u16  2  9      /1
Inverter_Ambient_Temp   s16  2  10     /10
Highest_IGBT_Temp_PU1   s16  2  11     /10
Highest_IGBT_Temp_PU21  s16  2  12     /10
Highest_IGBT_Temp_PU31  s16  2  13     /10
Highest_IGBT_Temp_PU41  s16  2  14     /10
Control_Section_Temp    s16  2  15     /10
Daily_kWh               u32  2  19,20  /1000
Total_kWh               u32  2  21,22  /10  *10
Daily_kVAh              u32  2  23,24  /1000
Total_kVAh              u32  2  25,26  /10  *10
""",
    "inv_abb_pvs980": """
Active_Power_Limit         s16  0  2      /10
QRef_Operation_Mode        s16  0  3      /1
Reactive_Power_Ref_kVAR    u16  0  4      /1
Reactive_Power_Ref_Per     u16  0  5      /10
PF_Reference               s16  0  6      /1000
Vac_Reference              s16  0  7      /10
Active_RampUp_Rate         s16  0  8      /1
Active_RampDown_Rate       s16  0  9      /1
Reactive_RampUp_Rate       s16  0  10     /1
Reactive_RampDown_Rate     s16  0  11     /1
Active_Power               s16  1  2      /1
Reactive_Power             s16  1  3      /1
Grid_Voltage               u16  1  4      /10
Grid_Frequency             u16  1  5      /100
PowerFactor                s16  1  6      /1000
Code_ActiveFault           u16  2  0      /1
L1_Voltage                 u16  2  1      /10
L2_Voltage                 u16  2  2      /10
L3_Voltage                 u16  2  3      /10
Grid_Current               u16  2  4      /10
DC_Input_Voltage           u16  2  5      /10
DC_Bus_Voltage             u16  2  6      /10
DC_Input_Current           u16  2  7      /10
Grounding_Current          u16  2  8      /1
Isolation_Resistance       u16  2  9      /1
Inverter_Ambient_Temp      s16  2  10     /10
Highest_IGBT_Temp_M1       s16  2  11     /10
Highest_IGBT_Temp_M2       s16  2  12     /10
Highest_IGBT_Temp_M3       s16  2  13     /10
Highest_IGBT_Temp_M4       s16  2  14     /10
Control_Section_Temp       s16  2  15     /10
Highest_Cabinet_Temp_M1    s16  2  16     /10
Highest_Cabinet_Temp_M2    s16  2  17     /10
Highest_Cabinet_Temp_M3    s16  2  18     /10
Highest_Cabinet_Temp_M4    s16  2  19     /10
Highest_LCL_Temp_M1        s16  2  20     /10
Highest_LCL_Temp_M2        s16  2  21     /10
Highest_LCL_Temp_M3        s16  2  22     /10
Highest_LCL_Temp_M4        s16  2  23     /10
Inverter_Section_Humidity  s16  2  24     /10
Daily_kWh                  u32  2  25,26  /1000
Total_kWh                  u32  2  27,28  /10  *10
Daily_kVAh                 u32  2  29,30  /1000
Total_kVAh                 u32  2  31,32  /10  *10
""",
    "sensor_irradiation_akfen": """
Irradiation  s16  1  0  /1  clamp
""",
    "sensor_kippzonen_smp11": """
Pyranometer_Irradiation  s16  1  0  /1  clamp
""",
    "sensor_lufft_ws600": """
Relative_Humidity  s16  1  10  /10
Air_Pressure       s16  1  14  /10
Wind_Direction     s16  1  18  /10
GlobalRadiation    s16  1  27  /10
Air_Temperature    s16  1  31  /10
Dew_Point          s16  1  35  /10
Wind_Speed         s16  1  42  /10
Precipitation      s16  1  48  /100
""",
    "sensor_sevensolar_3SISTMB": """
Irradiation    s16  1  0  /10  clamp
Ref_Cell_Temp  s16  1  7  /10
Ext_Cell_Temp  s16  1  8  /10
""",
}

# Names of the bits of a status word, lowest bit first; "-" is a
# bit that is not reported.
_MAIN = """ReadyToSwitchOn Faulted Warning MPPTEnabled GridStable DCVoltageWithinLimits
    StartInhibited ReducedRun RedundantRun QCompansation Limited"""
_LIMITING = """IGBTTempCurrentLimitation PfLimitation PuLimitation GridFaultLimitation
    ExternalPowerLimit FRTRecoveryLimit ShutdownRampLimit PowerGradientLimit FRTInteraction
    AmbientTempLimitation"""
_MPPT = "MPPTMode PowerLimitationActive MinVoltageLimitActive MaxVoltageLimitActive"
_GRID = """Undervoltage Overvoltage Underfrequency Overfrequency AntiIslandingTrip RoCoFTrip
    CombinatoryTrip MovingAverageTrip ZeroCrossingTrip LVRTTrip HVRTTrip ExternalMonitorTrip"""
_UNITS = (1, 2, 3, 4)

# Block, word, name prefix, bits.
STATUS_WORDS = {
    "inv_abb_pvs800": [
        (1, 1, "Status_Main_", f"{_MAIN} GridConnected"),
        (3, 1, "Status_Limiting_", f"{_LIMITING} - PowerSectionTempLimitation"),
        (3, 3, "Status_MPPT_", _MPPT),
        (3, 4, "Status_Grid_", _GRID),
        (3, 5, "Status_Fan_",
         "PowerUnit1 PowerUnit2 PowerUnit3 PowerUnit4 ISU1Fan ISU2Fan DoorFanCircuitBreaker"),
        (3, 7, "Status_Environment_",
         """ACBusbarThermalProtection DCBusbarThermalProtection ColdAmbientTempWarning
         ColdAmbientTempFault HotAmbientTempWarning HotAmbientTempFault IGBTTempWarning
         IGBTTempFault"""),
    ],
    "inv_abb_pvs980": [
        (0, 1, "Status_ControlWord_",
         """StopInverter PriorityMode NightQCompensation FaultReset TransferTrip RebootInverter
         OpenMVBreaker CloseMVBreaker"""),
        (3, 0, "Status_Electromechanical_",
         " ".join(f"{part}M{unit}"
                  for part in ("ACContactor", "DCContactor", "ACSwitch", "DCSwitch")
                  for unit in _UNITS)),
        (1, 1, "Status_Main_", _MAIN),
        (3, 3, "Status_Limiting_",
         f"""{_LIMITING} ControlSectionTempLimitation ACDCSectionTempLimitation
         LCLSectionTempLimitation - InputDCDCSectionTempLimitation"""),
        (3, 5, "Status_MPPT_", _MPPT),
        (3, 6, "Status_Grid_", _GRID),
        (3, 7, "Status_Fan_",
         " ".join(f"MainChannel{unit}Fan{fan}" for unit in _UNITS for fan in _UNITS)),
        (3, 8, "Status_Fan_",
         " ".join([f"LCLM{unit}Fan{fan}" for unit in _UNITS for fan in (1, 2)]
                  + [f"ACDCIndoorFanM{unit}" for unit in _UNITS])),
        (3, 9, "Status_Environment_",
         """- OverTempDetected ColdAmbientTempDetected ExcessHumidityDetected CabinetHeatingOn
         HotAmbientTempDetected ColdPowerSectionTemp"""),
        (3, 10, "Status_Fault_",
         """FastPoweroff AmbientSituation GroundingCurrent InsulationResistance
         GroundingCircuitVoltage ReverseCurrentFault DCOvercurrentFault PLCLinkFault FanFault
         ACContactor DCContactor DCSwitch MainCircuitSPDFault DCFuse 48VPowerSupply
         InternalSWFault1"""),
        (3, 11, "Status_Fault_",
         """48VBuffer 24VBuffer AuxCircuit LCLPressureSensor Door ACBreaker ACOvercurrent
         ShortCircuit BUCurrentDifference InputPhaseLoss ControlSectionOverTemp IGBTOverTemp
         ACDCCabinetOverTemp LCLSectionOverTemp PowerUnitLost InternalSWFault2"""),
        (3, 12, "Status_Alarm_",
         """GroundingCurrentSuddenChange ResidualCurrent GroundingCurrentOvervoltage
         InsulationResistance TempSensorAlarm SCADADataInputOutOfRange DCLinkOvervoltage
         DCInputOvervoltage MainCircuit SPD 48VPowerSupply 48VBuffer 24VBuffer
         AuxCircuitBreaker LCLPressureSensor ACDCDoor"""),
    ],
}
